"""Sampling, top-k and ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cosine, literal_vector
from .retrieval import bm25


def _count(df: DataFrame, samples: int | float) -> int:
    """A number of rows as it is; a fraction of all rows, rounded down."""
    return int(samples * df.count()) if isinstance(samples, float) and samples < 1 else int(samples)


def seeded(order: list[str], seed: int) -> Column:
    """A random order that only depends on the seed and the row's key; md5, so other engines can repeat it."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in order]).cast("binary"))


def _ranked(df: DataFrame, strata: list[str], by: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*strata).orderBy(*by)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def sample(df: DataFrame, *, method: str, samples=None, order: list[str], name: str = "sample", stratify: list[str] | None = None, per_group: bool = False, seed: int = 42, **kwargs) -> DataFrame:
    """uniform, first, custom, outliers, top_embedding or top_fts; a float under 1 is a share of the rows.

    Unstratified uniform and first samples are a bounded top-n. ``stratify`` without ``per_group`` splits the number
    over the strata: for uniform by largest remainder, for first by whole shares topped up from what is left.
    """
    strata = stratify or []
    key = [F.col(c) for c in order]
    if method == "custom":
        return custom(df, samples, order=order)
    if method == "outliers":
        return outliers(df, samples=samples if samples is not None else kwargs.pop("samples", None), order=order, strata=strata, **kwargs)
    if method in ("top_embedding", "top_fts"):
        scored = _scored(df, method, order, **kwargs)
        return _top(scored, name, samples, order, strata, per_group)
    by = {"first": key, "uniform": [seeded(order, seed), *key]}[method]
    if strata and per_group:
        n = samples
        if isinstance(samples, float) and samples < 1:
            size = F.count("*").over(Window.partitionBy(*strata))
            w = Window.partitionBy(*strata).orderBy(*by)
            return df.withColumns({"__rn": F.row_number().over(w), "__n": F.floor(size * samples)}).where("__rn <= __n").drop("__rn", "__n")
        return _ranked(df, strata, by, int(n))
    n = _count(df, samples)
    if not strata:
        return df.orderBy(*by).limit(n)
    # Allocation: whole shares, then one more row each to the strata of the largest remainders (uniform), or what is
    # missing from the first rows left over (first).
    counts = df.groupBy(*strata).agg(F.count("*").alias("__size"))
    total = df.count()
    counts = counts.withColumn("__whole", F.floor(F.lit(n) * F.col("__size") / F.lit(max(total, 1))))
    counts = counts.withColumn("__rest", (F.lit(n) * F.col("__size")) % F.lit(max(total, 1)))
    missing = n - (counts.agg(F.sum("__whole")).first()[0] or 0)
    if method == "uniform":
        more = counts.orderBy(F.desc("__rest"), *strata).limit(max(0, missing)).select(*strata, F.lit(1).alias("__more"))
        counts = counts.join(more, strata, "left").withColumn("__whole", F.least("__size", F.col("__whole") + F.coalesce("__more", F.lit(0))))
        joined = df.join(counts.select(*strata, "__whole"), strata)
        w = Window.partitionBy(*strata).orderBy(*by)
        return joined.withColumn("__rn", F.row_number().over(w)).where("__rn <= __whole").select(*df.columns)
    w = Window.partitionBy(*strata).orderBy(*by)
    ranked = df.join(counts.select(*strata, "__whole", "__size"), strata).withColumn("__rn", F.row_number().over(w))
    # The whole shares come first, then the rest of the largest strata.
    rest = [F.when(F.col("__rn") <= F.col("__whole"), 0).otherwise(1), F.desc("__size"), *[F.col(c) for c in strata], F.col("__rn")]
    return ranked.orderBy(*rest).limit(n).select(*df.columns)


def custom(df: DataFrame, wanted: list[dict], *, order: list[str]) -> DataFrame:
    """The rows that match the listed keys; of several the last by ``order``."""
    keys = list(wanted[0])
    listed = df.sparkSession.createDataFrame([tuple(w[k] for k in keys) for w in wanted], df.select(*keys).schema).dropDuplicates()
    found = df.join(F.broadcast(listed), keys, "left_semi")
    return _ranked(found, keys, [F.desc(c) for c in order], 1)


def outliers(df: DataFrame, *, vector: str, order: list[str], samples=None, std: float | None = None, keep: bool = False, center=None, strata: list[str] | None = None) -> DataFrame:
    """Rows beyond (``keep``) or within a distance of the mean vector, of each stratum if given.

    The cut-off is ``std`` times the root of the summed variances, or the distance of the n-th nearest row.
    """
    strata = strata or []
    each = df.select(*strata, F.posexplode(vector).alias("__d", "__v"))
    stats = each.groupBy(*strata, "__d").agg(F.avg("__v").alias("m"), F.var_pop("__v").alias("v"))
    stats = stats.groupBy(*strata).agg(F.transform(F.array_sort(F.collect_list(F.struct("__d", "m"))), lambda s: s["m"]).alias("__mean"), F.sqrt(F.sum("v")).alias("__spread"))
    df2 = df.join(F.broadcast(stats), strata) if strata else df.crossJoin(F.broadcast(stats))  # one row without strata
    middle = literal_vector(center) if center is not None else F.col("__mean")
    squares = F.zip_with(F.col(vector), middle, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    df2 = df2.withColumn("__far", F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))
    if std is not None:
        beyond = F.col("__far") > std * F.col("__spread")
        return df2.where(beyond if keep else ~beyond).select(*df.columns)
    if strata:
        size = F.count("*").over(Window.partitionBy(*strata))
        w = Window.partitionBy(*strata).orderBy("__far", *order)
        n = F.floor(size * samples) if isinstance(samples, float) and samples < 1 else F.lit(int(samples))
        df2 = df2.withColumns({"__rn": F.row_number().over(w), "__n": n})
        inside = F.col("__rn") <= F.col("__n") + 1
        return df2.where(~inside if keep else inside).select(*df.columns)
    n = _count(df, samples)
    nearest = df2.orderBy("__far", *order).limit(n + 1).agg(F.max("__far")).first()[0]  # a bounded top-n
    beyond = F.col("__far") > F.lit(nearest)
    return df2.where(beyond if keep else ~beyond).select(*df.columns)


def _scored(df: DataFrame, method: str, order: list[str], *, keys: list[str] | None = None, query=None, vector: str | None = None, digits: int = 6) -> DataFrame:
    if method == "top_embedding":
        return df.withColumn("__score", F.round(cosine(F.col(vector), literal_vector(query)), digits))
    return bm25(df, keys=keys, query=query, order=order, score="__score", digits=digits)


def _top(df: DataFrame, name: str, samples, order: list[str], strata: list[str], per_group: bool) -> DataFrame:
    """The rows of the highest scores, ties by ``order``; rows without a score fill up."""
    by = [F.desc("__score"), *[F.col(c) for c in order]]
    n = samples if per_group else _count(df, samples)
    if strata:
        df = _ranked(df, strata, by, int(n))
    if not (strata and per_group):
        df = df.orderBy(*by).limit(int(n))
        rank = F.row_number().over(Window.orderBy(*by))  # of n rows
    else:
        rank = F.row_number().over(Window.partitionBy(*strata).orderBy(*by))
    return df.withColumns({f"_{name}_rank": rank, f"_{name}_score": F.col("__score")}).drop("__score")


def topk(df: DataFrame, *, method: str, k, order: list[str], name: str = "topk", stratify: list[str] | None = None, **kwargs) -> DataFrame:
    """The k best rows (a share if k is under 1) by ``embedding``, ``fts`` or ``llm_compare``, of each stratum if given."""
    if method == "llm_compare":
        return rank(df, order=order, **kwargs).where(F.col("_rank") <= _count(df, k))
    return sample(df, method=f"top_{method}", samples=k, order=order, name=name, stratify=stratify, per_group=bool(stratify), **kwargs)


def rank(df: DataFrame, *, order: list[str], score: Column, descending: bool = True, k: int | None = None, pick: Callable[[list[dict], int], list[int]] | None = None, window: int = 10, top: int = 3, overlap: float = 0.5, budget: int = 10, fields: list[str] | None = None) -> DataFrame:
    """``_rank`` from 1 by a score (similarity to the criterion, a 1-7 rating, wins), then refined at the top.

    The first order is a sort. With ``pick`` (rows of a window, m) -> places of its best m, the first ``k`` rows are
    refined from the back in windows that overlap; each moves its picks to its front. That is sequential by nature and
    sees at most ``k`` rows, on the driver, in at most ``budget`` calls.
    """
    by = [F.desc("__s") if descending else F.asc("__s"), *[F.col(c) for c in order]]
    df = df.withColumn("__s", score)
    if pick is None or not k:
        return _numbered(df, by).drop("__s")
    head = df.orderBy(*by).limit(k).select(*order, *[c for c in (fields or []) if c not in order]).collect()
    rows, step, at, calls = [r.asDict() for r in head], max(1, int(window * (1 - overlap))), len(head), 0
    while at > 0 and calls < budget:
        low = max(0, at - window)
        part = rows[low : low + window]
        best = list(dict.fromkeys(i for i in pick(part, min(top, len(part))) if 0 <= i < len(part)))
        rows[low : low + window] = [part[i] for i in best] + [x for i, x in enumerate(part) if i not in best]
        calls, at = calls + 1, at - step if low else 0
    places = df.sparkSession.createDataFrame([(*[r[c] for c in order], i + 1) for i, r in enumerate(rows)], df.select(*order).schema.add("__place", "long"))
    df = df.join(F.broadcast(places), order, "left")  # k rows
    return _numbered(df, [F.asc_nulls_last("__place"), *by]).drop("__s", "__place")


def _numbered(df: DataFrame, by: list[Column]) -> DataFrame:
    """``_rank`` over all rows without one task for all: range partitions are numbered alone and shifted by what is before them."""
    part = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id())
    part = part.withColumns({"__p": F.shiftright("__id", 33), "__k": F.col("__id").bitwiseAND((1 << 33) - 1)})
    sizes = part.groupBy("__p").agg((F.max("__k") + 1).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per partition
    return part.join(F.broadcast(before.drop("__n")), "__p").withColumn("_rank", F.col("__before") + F.col("__k") + 1).drop("__p", "__k", "__id", "__before")


def pairwise_wins(df: DataFrame, *, order: list[str], batches: int, size: int, wins: Callable[[list[dict]], list[int]], fields: list[str], seed: int = 42) -> DataFrame:
    """``wins``: how often a row comes first in seeded random batches of ``size`` rows; for small candidate sets."""
    rows = [r.asDict() for r in df.select(*dict.fromkeys([*order, *fields])).orderBy(*order).limit(10_000).collect()]
    import random

    draw, count = random.Random(seed), [0] * len(rows)
    for _ in range(batches):
        own = draw.sample(range(len(rows)), min(size, len(rows)))
        for place, i in enumerate(wins([rows[j] for j in own])):  # places of the batch, best first
            count[own[i]] += len(own) - 1 - place
    schema = df.select(*order).schema.add("wins", "long")
    won = df.sparkSession.createDataFrame([(*[r[c] for c in order], n) for r, n in zip(rows, count, strict=True)], schema)
    return df.join(F.broadcast(won), order, "left")


def calibrated(df: DataFrame, *, order: list[str], vector: str, anchors: list[tuple[int, list[float]]]) -> DataFrame:
    """``_rank`` by the place of the most similar anchor (place, vector), nearer rows first; a handful of anchors."""
    best = F.array_max(F.array(*[F.struct(F.round(cosine(F.col(vector), literal_vector(v)), 9).alias("s"), F.lit(-place).alias("place")) for place, v in anchors]))
    df = df.withColumn("__best", best)
    return _numbered(df, [F.desc("__best.place"), F.desc("__best.s"), *[F.col(c) for c in order]]).drop("__best")
