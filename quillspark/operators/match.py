"""Fuzzy joins: equijoin, entity resolution, link resolution.

Candidates come from blocking: each condition is its own equi-join (a disjunction would be a nested loop), similarity
is a threshold on cosine between blocks. A pair that several conditions propose is compared once.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import cosine
from .graph import components, stored

#: Pairs that are all compared when nothing blocks.
SMALL = 100
#: Matches wanted of a row up to which the rows of a block are thinned out before the join; each takes a window.
LAYERS = 16


def _prefixed(df: DataFrame, prefix: str) -> list[Column]:
    return [F.col(f"`{c}`").alias(prefix + c) for c in df.columns]


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _parts(compare) -> list[str]:
    """The conditions of a plain conjunction; none of anything that isn't plainly one."""
    if not isinstance(compare, str) or re.search(r"['\"`]|--|/\*|\b(or|xor|case|between)\b|\|", compare, re.I):
        return []
    parts = [x.strip() for x in re.split(r"\band\b", compare, flags=re.I)]
    return parts if all(x.count("(") == x.count(")") for x in parts) else []


def _band(compare, left: DataFrame, right: DataFrame) -> tuple[str, str, float] | None:
    """(left column, right column, width) if matches must differ by less in two numbers."""
    for x in _parts(compare):
        if m := re.fullmatch(r"abs\(\s*([lr])_(\w+)\s*-\s*([lr])_(\w+)\s*\)\s*<=?\s*(\d+(?:\.\d+)?)", x, re.I):
            a, b = (m[2], m[4]) if m[1].lower() == "l" else (m[4], m[2])
            if m[1].lower() != m[3].lower() and a in left.columns and b in right.columns and _numeric(left, a) and _numeric(right, b) and float(m[5]) > 0:
                return a, b, float(m[5])
    return None


def _above(compare, one: tuple[str, DataFrame], other: tuple[str, DataFrame]) -> tuple[str, bool] | None:
    """(column, whether more of it matches more) of one side's rows, if the comparison is an inequality of two columns."""
    parts = _parts(compare)
    m = re.fullmatch(r"([lr])_(\w+)\s*(<=?|>=?)\s*([lr])_(\w+)", parts[0], re.I) if len(parts) == 1 else None
    if not m or m[1].lower() == m[4].lower():
        return None
    own, far, more = (m[2], m[5], ">" in m[3]) if m[1].lower() == one[0] else (m[5], m[2], "<" in m[3])
    if own not in one[1].columns or far not in other[1].columns:
        return None
    kinds = one[1].schema[own].dataType, other[1].schema[far].dataType
    return (own, more) if kinds[0] == kinds[1] or (_numeric(one[1], own) and _numeric(other[1], far)) else None


def _leading(rows: DataFrame, key: str, order: str, value: str, more: bool, n: int) -> DataFrame:
    """The rows of each key that can be among the first n, by ``order``, of those beyond some value.

    A row with n rows before it that reach as far can't be. So what stays is n layers of rows that exceed all before
    them: about n times the logarithm of a key's rows, unless they are sorted. Parts of a key first, then what they leave.
    """
    best = F.max if more else F.min
    parts = rows.sparkSession.sparkContext.defaultParallelism * 4
    for by in ([key, F.pmod(F.xxhash64(order), F.lit(parts))], [key]):
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).withColumn("__in", F.lit(False))
        for _ in range(n):
            rows = rows.withColumn("__best", best(F.when(~F.col("__in"), F.col(value))).over(w))
            ahead = F.col(value) > F.col("__best") if more else F.col(value) < F.col("__best")
            rows = rows.withColumn("__in", F.col("__in") | F.col("__best").isNull() | ahead)
        rows = rows.where("__in").drop("__in", "__best")
    return rows


def _bands(value: Column, width: float) -> Column:
    """Whole numbers that differ by one at most for values that differ by ``width`` at most; all huge ones are alike."""
    far = float(2**50)
    return F.rint(F.greatest(F.least(value.cast("double") / (width * 1.001), F.lit(far)), F.lit(-far))).cast("long")


def pairs(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, conditions: list[str | tuple[str, str]] = (), vectors: tuple[str, str] | None = None, threshold: float | None = None, compare=None, first: tuple[str, int] | None = None) -> DataFrame:
    """``l_*`` and ``r_*`` of every pair of rows that a condition or similarity proposes, once each, with their ids l and r.

    A pair belongs to the first condition that proposes it, so none is shuffled to be made distinct. Pairs that
    ``compare`` rules out may be left out: a band of two numbers becomes part of the key, and if only the first n
    matches of each row are wanted (``first``: the side of the limit, n), an inequality leaves few rows of a block.
    """
    band = _band(compare, left, right)
    a = left.select(F.col(left_id).alias("l"), *_prefixed(left, "l_"), *[F.expr(c[0]).alias(f"__a{i}") for i, c in enumerate(conditions) if isinstance(c, tuple)])
    b = right.select(F.col(right_id).alias("r"), *_prefixed(right, "r_"), *[F.expr(c[1]).alias(f"__b{i}") for i, c in enumerate(conditions) if isinstance(c, tuple)])
    kept = [c for c in a.columns + b.columns if c[:2] != "__"]
    proposed, found = [], []
    for i, c in enumerate(conditions):
        proposed.append(F.col(f"__a{i}") == F.col(f"__b{i}") if isinstance(c, tuple) else F.expr(c))
        x, y, on = a, b, proposed[-1]
        if isinstance(c, tuple):
            if first and first[1] <= LAYERS:
                if first[0] == "left" and (by := _above(compare, ("r", right), ("l", left))):
                    y = _leading(y, f"__b{i}", "r", f"r_{by[0]}", by[1], first[1])
                elif first[0] == "right" and (by := _above(compare, ("l", left), ("r", right))):
                    x = _leading(x, f"__a{i}", "l", f"l_{by[0]}", by[1], first[1])
            if band:
                at = _bands(F.col(f"l_{band[0]}"), band[2])
                x = x.withColumn("__at", F.explode(F.array(at - 1, at, at + 1)))
                y = y.withColumn("__band", _bands(F.col(f"r_{band[1]}"), band[2]))
                on = on & (F.col("__at") == F.col("__band"))
            x = x.hint("merge")  # a broadcast would leave all pairs to the few tasks that read a file
        both = x.join(y, on)
        for earlier in proposed[:-1]:
            both = both.where(~F.coalesce(earlier, F.lit(False)))
        found.append(both.select(*kept))
    if vectors and threshold is not None:
        both = a.join(b, F.round(cosine(F.col(f"l_{vectors[0]}"), F.col(f"r_{vectors[1]}")), 9) >= threshold)
        for earlier in proposed:
            both = both.where(~F.coalesce(earlier, F.lit(False)))
        found.append(both.select(*kept))
    if not found:
        if left.limit(SMALL + 1).count() * right.limit(SMALL + 1).count() > SMALL:
            raise ValueError(f"more than {SMALL} pairs need blocking")
        found.append(a.join(b, F.lit(True)))
    return reduce(DataFrame.unionByName, found)


def candidates(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, conditions: list[str | tuple[str, str]] = (), vectors: tuple[str, str] | None = None, threshold: float | None = None) -> DataFrame:
    """Distinct (l, r) ids that a condition or similarity proposes.

    conditions: pairs of SQL expressions (left, right) that must be equal, or SQL over ``l_*`` and ``r_*`` columns.
    Similarity compares all vectors of both sides; give it sides that other means have cut to size.
    """
    return pairs(left, right, left_id=left_id, right_id=right_id, conditions=conditions, vectors=vectors, threshold=threshold).select("l", "r").distinct()


def pick_threshold(scored: DataFrame, label: Callable[[DataFrame], DataFrame], *, recall: float = 0.95, size: int = 100, seed: int = 42) -> float:
    """The highest of a hundred cosine thresholds that keeps ``recall`` of the matches in a labelled sample.

    scored: (l, r, sim). Half of the sample is spread over ten bands of similarity, half favours similar pairs.
    Without any match it is the 99th percentile.
    """
    noise = (F.pmod(F.xxhash64(F.lit(seed), "l", "r"), F.lit(1_000_003)) + 1) / 1_000_003.0
    band = F.floor(F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.col("sim"))) * 10)
    w = Window.partitionBy(band).orderBy(noise)
    even = scored.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max(1, size // 20)).drop("__rn")
    steep = scored.orderBy(-F.pow(noise, F.exp(-20 * F.col("sim")))).limit(size // 2)
    rows = label(even.unionByName(steep).dropDuplicates(["l", "r"])).select("sim", "match").collect()
    good = sorted(r.sim for r in rows if r.match)
    if not good:
        return scored.agg(F.percentile_approx("sim", 0.99)).first()[0] or 1.0
    steps = [i / 99 for i in range(99)]
    return max((t for t in steps if sum(s >= t for s in good) >= recall * len(good)), default=0.0)


def compared(both: DataFrame, *, compare: Column | str | Callable[[DataFrame], DataFrame], limit: int | None = None, lengths: tuple[str, str] | None = None) -> DataFrame:
    """Those of :func:`pairs` that match. compare: SQL over ``l_*`` and ``r_*``, or pairs to pairs with ``match`` (a model)."""
    if limit is not None:
        size = F.length(lengths[0]) + F.length(lengths[1]) if lengths else F.lit(0)
        both = both.orderBy(F.desc(size), "l", "r").limit(limit)
    if callable(compare) and not isinstance(compare, Column):
        return compare(both).where("match")
    return both.where(compare)


def limited(matches: DataFrame, *, left_limit: int | None = None, right_limit: int | None = None) -> DataFrame:
    """At most so many matches of each row, in order of (l, r).

    One-sided limits are row numbers. With both, a pair counts if both rows are under their limits by then; that is
    sequential among pairs that share rows, so it runs within connected components of the matches.
    """
    if left_limit is None and right_limit is None:
        return matches
    if right_limit is None or left_limit is None:
        key, other, n = ("l", "r", left_limit) if right_limit is None else ("r", "l", right_limit)
        w = Window.partitionBy(key).orderBy(other)
        return matches.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
    matches = stored(matches)
    named = matches.withColumns({"a": F.concat(F.lit("l"), F.col("l").cast("string")), "b": F.concat(F.lit("r"), F.col("r").cast("string"))})
    roots = components(named).withColumnRenamed("node", "a")

    def greedy(group):
        seen_l, seen_r, keep = {}, {}, []
        for row in group.sort_values(["l", "r"]).itertuples():
            ok = seen_l.get(row.l, 0) < left_limit and seen_r.get(row.r, 0) < right_limit
            keep.append((row.Index, ok))
            if ok:
                seen_l[row.l], seen_r[row.r] = seen_l.get(row.l, 0) + 1, seen_r.get(row.r, 0) + 1
        return group.loc[[i for i, ok in keep if ok], ["l", "r"]]

    return named.join(roots, "a").groupBy("root").applyInPandas(greedy, matches.schema)


def equijoin(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, compare, conditions=(), vectors=None, threshold=None, limits: dict | None = None, limit_comparisons: int | None = None, lengths: tuple[str, str] | None = None) -> DataFrame:
    """Inner join of the pairs that match; columns of both sides' names get ``_left`` and ``_right``."""
    sides = [side for side in ("left", "right") if (limits or {}).get(side) is not None]
    first = (sides[0], limits[sides[0]]) if len(sides) == 1 and limit_comparisons is None else None
    both = pairs(left, right, left_id=left_id, right_id=right_id, conditions=conditions, vectors=vectors, threshold=threshold, compare=compare if limit_comparisons is None else None, first=first)
    found = compared(both, compare=compare, limit=limit_comparisons, lengths=lengths)
    names = set(left.columns) & set(right.columns)
    mine = [F.col(f"`{p}{c}`").alias(f"{c}_{side}" if c in names else c) for p, side, df in (("l_", "left", left), ("r_", "right", right)) for c in df.columns]
    if not sides and not (callable(compare) and not isinstance(compare, Column)):
        return found.select(*mine)
    found = limited(found.select("l", "r"), left_limit=(limits or {}).get("left"), right_limit=(limits or {}).get("right"))
    a = left.select(F.col(left_id).alias("__l"), *_prefixed(left, "l_"))
    b = right.select(F.col(right_id).alias("__r"), *_prefixed(right, "r_"))
    return found.join(a, F.col("l") == F.col("__l")).join(b, F.col("r") == F.col("__r")).select(*mine)


def clusters(df: DataFrame, *, id_key: str, compare, conditions=(), vectors: str | None = None, threshold=None, equal_keys: list[str] = (), limit_comparisons=None) -> DataFrame:
    """``df`` with ``__cluster``, the least id of the rows that matches connect.

    Rows whose ``equal_keys`` are all equal (any case) match without comparison; they are linked in a star, never in pairs.
    """
    both = pairs(df, df, left_id=id_key, right_id=id_key, conditions=conditions, vectors=(vectors, vectors) if vectors else None, threshold=threshold, compare=compare if limit_comparisons is None else None).where("l < r")
    edges = compared(both, compare=compare, limit=limit_comparisons).select("l", "r")
    if equal_keys:
        own = F.concat_ws("\x01", *[F.lower(F.col(k).cast("string")) for k in equal_keys])
        keyed = df.select(F.col(id_key).alias("r"), own.alias("k"))
        star = keyed.groupBy("k").agg(F.min("r").alias("l"), F.count("*").alias("n")).where("n > 1")
        edges = edges.unionByName(keyed.join(star, "k").where("l < r").select("l", "r"))
    roots = components(edges, "l", "r").select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return df.join(roots, F.col(id_key) == F.col("__node"), "left").withColumn("__cluster", F.coalesce("__root", F.col(id_key))).drop("__node", "__root")


def resolve(df: DataFrame, *, id_key: str, keys: list[str], compare, name: str = "resolve", canonical: Callable[[DataFrame], DataFrame] | None = None, **blocking) -> DataFrame:
    """Every member of a cluster gets its canonical ``keys``; rows stay.

    Without ``canonical`` (clusters' rows to ``__cluster`` and keys: a model, one call for each cluster of more than one)
    it is a majority vote for each key, the least value on a tie. The values before are kept aside.
    """
    df = clusters(df, id_key=id_key, compare=compare, **blocking)
    before = F.struct(*keys).alias(f"_kv_pairs_preresolve_{name}")
    if canonical is not None:
        size = F.count("*").over(Window.partitionBy("__cluster"))
        voted = canonical(df.withColumn("__n", size).where("__n > 1").drop("__n"))
    else:
        voted = None
        for k in keys:
            counted = df.groupBy("__cluster", k).agg(F.count("*").alias("n"))
            best = counted.groupBy("__cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(k).alias("v")))["v"].alias(k))
            voted = best if voted is None else voted.join(best, "__cluster")
    voted = voted.select("__cluster", *[F.col(k).alias(f"__{k}") for k in keys])
    out = df.join(voted, "__cluster", "left")
    rest = [c for c in df.columns if c not in keys and c != "__cluster"]
    return out.select(*rest, before, *[F.coalesce(f"__{k}", k).alias(k) for k in keys])


def link_resolve(df: DataFrame, *, id_key: str = "title", link_key: str = "related_to", similar: Callable[[DataFrame, DataFrame], DataFrame], compare: Column | str = "true") -> DataFrame:
    """Links that name no id are repointed to the most similar id that matches (the lesser on a tie), or stay.

    similar: (link) and (id) tables to (link, id, score) candidates above a threshold.
    """
    ids = df.select(F.col(id_key).alias("id")).distinct()
    links = df.select(F.explode(link_key).alias("link")).distinct().join(ids, F.col("link") == F.col("id"), "left_anti")
    best = similar(links, ids).where(compare).groupBy("link").agg(F.min(F.struct((-F.col("score")).alias("s"), "id"))["id"].alias("to"))
    each = df.select(F.col(id_key).alias("__id"), F.posexplode(link_key).alias("__at", "link")).join(best, "link", "left")
    fixed = each.groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", F.coalesce("to", "link").alias("v")))), lambda s: s["v"]).alias("__links"))
    out = df.join(fixed, F.col(id_key) == F.col("__id"), "left").withColumn(link_key, F.coalesce("__links", link_key))
    return out.drop("__id", "__links").select(*df.columns)


def model_compare(model, prompt, *, kinds=None) -> Callable[[DataFrame], DataFrame]:
    """A comparison by a model client: the prompt reads ``left`` and ``right``."""
    import pandas as pd

    from ..functions.models import Call
    from ..functions.schema import parse_schema
    from ..functions.templates import Template

    call, template = Call(model, kinds or parse_schema({"is_match": "boolean"})), Template(prompt, "left")

    def run(pairs: DataFrame) -> DataFrame:
        def each(rows: pd.DataFrame) -> pd.Series:
            out = []
            for r in rows.to_dict("records"):
                sides = ({k[2:]: v for k, v in r.items() if k.startswith(p)} for p in ("l_", "r_"))
                ok, _, got = call.run(template.render(**dict(zip(("left", "right"), sides, strict=True))))
                out.append(bool(ok and got["is_match"]))
            return pd.Series(out)

        each.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
        return pairs.withColumn("match", F.pandas_udf(each, T.BooleanType())(F.struct(*[c for c in pairs.columns if c[:2] in ("l_", "r_")])))

    return run
