"""Grouping operators: reduce (batch, fold, fold and merge), code reduce, value sampling."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.models import Expressions
from ..functions.schema import parse_schema, spark_schema
from ..functions.text import cosine, literal_vector

ALL = "_all"


def _keys(df: DataFrame, keys: str | list[str]) -> tuple[DataFrame, list[str]]:
    """Group keys; list-valued ones are compared as sorted lists."""
    names = [] if keys in (ALL, [ALL]) else [keys] if isinstance(keys, str) else list(keys)
    for k in names:
        if isinstance(df.schema[k].dataType, T.ArrayType):
            df = df.withColumn(k, F.array_sort(k))
    return df, names


def smallest_groups(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The rows of the ``n`` smallest groups; of equal sizes the lower keys."""
    chosen = df.groupBy(*keys).agg(F.count("*").alias("__n")).orderBy("__n", *keys).limit(n)
    for k in keys:
        chosen = chosen.withColumnRenamed(k, f"__{k}")
    on = [df[k].eqNullSafe(chosen[f"__{k}"]) for k in keys]
    return df.join(chosen, on, "left_semi")


def sample_values(df: DataFrame, keys: list[str], *, method: str, size: int, order: list[str], seed: int = 42, vector: str | None = None, query=None, clusters: Callable | None = None) -> DataFrame:
    """At most ``size`` rows of each group: first_n, random (seeded), sem_sim (nearest to ``query``) or cluster
    (the rows nearest to the centres of ``size`` seeded clusters of the group's vectors)."""
    if method == "first_n":
        by = [F.col(c) for c in order]
    elif method == "random":
        by = [F.xxhash64(F.lit(seed), *order)]
    elif method == "sem_sim":
        by = [F.desc(F.round(cosine(F.col(vector), literal_vector(query)), 9)), *[F.col(c) for c in order]]
    elif method == "cluster":
        # Spread along a seeded direction: one row of each of ``size`` equal slices.
        width = len(df.select(vector).first()[0])
        direction = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.pmod(F.xxhash64(F.lit(seed), i), F.lit(2001)) - 1000) / 1000.0)
        w = Window.partitionBy(*keys).orderBy(cosine(F.col(vector), direction), *order)
        df = df.withColumn("__slice", F.ntile(size).over(w))
        first = Window.partitionBy(*keys, "__slice").orderBy(*order)
        return df.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__rn", "__slice")
    else:
        raise ValueError(f"unknown method: {method}")
    w = Window.partitionBy(*keys).orderBy(*by, *order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= size).drop("__rn")


def _extras(df: DataFrame, name: str, order: list[str], pass_through: list[str], lineage: list[str], counts: bool = True) -> list[Column]:
    """Aggregates that go with every reduce: size, first row's fields, lineage."""
    first = F.struct(*order) if len(order) > 1 else F.col(order[0])
    out = [F.count("*").alias(f"_counts_prereduce_{name}")] if counts else []
    out += [F.min_by(c, first).alias(c) for c in pass_through]
    if lineage:
        out.append(F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("__o"), *lineage))), lambda s: F.struct(*[s[c].alias(c) for c in lineage])).alias(f"{name}_lineage"))
    return out


def code_reduce(df: DataFrame, code: dict[str, Column] | Callable[[list[dict]], dict], *, keys: str | list[str] = ALL, order: list[str] | None = None, name: str = "code_reduce", output: str | None = None, pass_through=(), limit: int | None = None) -> DataFrame:
    """Aggregates (preferred), or a Python function from the group's rows in ``order`` to a dict with the ``output`` schema.

    ``limit`` keeps the smallest groups. Aggregates combine before the shuffle; a Python function sees a whole group in
    one task, so it is for groups of bounded size.
    """
    df, names = _keys(df, keys)
    order = order or df.columns[:1]
    if limit is not None and names:
        df = smallest_groups(df, names, limit)
    extra = _extras(df, name, order, [c for c in pass_through if c not in names], [])
    if isinstance(code, dict):
        return df.groupBy(*names).agg(*[c.alias(n) for n, c in code.items() if n not in names], *extra)
    made = T._parse_datatype_string(output)
    schema = T.StructType([*[df.schema[k] for k in names], *[f for f in made.fields if f.name not in names], T.StructField(f"_counts_prereduce_{name}", T.LongType()), *[df.schema[c] for c in pass_through if c not in names]])

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        records = rows.to_dict("records")
        out = {k: records[0][k] for k in names} | {f.name: v for f, v in zip(made.fields, map(code(records).get, made.names), strict=True)}
        out |= {f"_counts_prereduce_{name}": len(records)} | {c: records[0][c] for c in pass_through}
        return pd.DataFrame([{n: out[n] for n in schema.names}], columns=schema.names)

    return df.groupBy(*names).applyInPandas(each, schema)


def reduce_groups(df: DataFrame, *, keys: str | list[str], output: dict[str, str], model, prompt: str = "", name: str = "reduce", order: list[str] | None = None, fields: list[str] | None = None, fold_prompt: str | None = None, fold_batch: int | None = None, merge_prompt: str | None = None, merge_batch: int = 2, associative: bool = True, sampling: dict | None = None, pass_through=(), lineage=(), limit: int | None = None, intermediates: bool = False, retries: int = 2) -> DataFrame:
    """One typed output per group, with its size, the first row's ``pass_through`` fields and lineage.

    An expression model's outputs are aggregates. A client is given ``inputs`` (the group's rows in ``order``): all at
    once; or ``fold_batch`` at a time with the ``output`` so far; or, with a merge prompt, folded in independent batches
    (a row each, so they run in parallel) whose outputs are merged ``merge_batch`` at a time until one is left.
    A group whose answer stays invalid goes.
    """
    kinds = parse_schema(output)
    df, names = _keys(df, keys)
    order = order or df.columns[:1]
    if limit is not None and names:
        df = smallest_groups(df, names, limit)
    extra = df.groupBy(*names).agg(*_extras(df, name, order, [c for c in pass_through if c not in names], list(lineage)))
    rows = sample_values(df, names, order=order, **sampling) if sampling else df
    if isinstance(model, Expressions):
        made = rows.groupBy(*names).agg(*[F.expr(model.outputs[n]).cast(k.spark()).alias(n) for n, k in kinds.items()])
        return _beside(made, extra, names)
    from ..functions.models import Call
    from ..functions.templates import Template

    call = Call(model, kinds, retries)
    shown = fields or df.columns
    main, fold, merge = (Template(t, "inputs") if t else None for t in (prompt, fold_prompt or prompt, merge_prompt))
    kept = [T.StructField(f"_{name}_intermediates", T.ArrayType(T.StringType()))] if intermediates else []
    schema = T.StructType([*[df.schema[k] for k in names], T.StructField("__ok", T.BooleanType()), *spark_schema(kinds).fields, *kept])

    def result(group: pd.DataFrame, ok: bool, out: dict, steps: list) -> pd.DataFrame:
        row = {k: group[k].iloc[0] for k in names} | {"__ok": ok} | {n: out.get(n) if ok else None for n in kinds}
        if intermediates:
            row[f"_{name}_intermediates"] = [str(s) for s in steps]
        return pd.DataFrame([row], columns=schema.names)

    if merge and fold_batch and associative:
        w = Window.partitionBy(*names).orderBy(*order)
        rows = rows.withColumn("__part", F.floor((F.row_number().over(w) - 1) / fold_batch))
        part = T.StructField("__part", T.LongType())
        level = T.StructType([*schema.fields, part])

        def folded(group: pd.DataFrame) -> pd.DataFrame:
            records = group.sort_values(order, kind="stable")[shown].to_dict("records")
            ok, _, out = call.run(fold.render(inputs=records, output={}, reduce_key={k: group[k].iloc[0] for k in names}))
            return result(group, ok, out, [out]).assign(__part=group["__part"].iloc[0])

        rows = rows.groupBy(*names, "__part").applyInPandas(folded, level)
        n = rows.groupBy(*names).count().agg(F.max("count")).first()[0] or 0
        while n > 1:  # each round leaves a merge_batch-th

            def merged(group: pd.DataFrame) -> pd.DataFrame:
                group = group.sort_values("__part", kind="stable")
                if len(group) == 1:
                    return group[level.names].assign(__part=group["__part"] // merge_batch)
                outs = group[list(kinds)].to_dict("records")
                ok, _, out = call.run(merge.render(outputs=outs, inputs=outs, reduce_key={k: group[k].iloc[0] for k in names}))
                return result(group, ok and bool(group["__ok"].all()), out, [*outs, out]).assign(__part=group["__part"].iloc[0] // merge_batch)

            rows = rows.withColumn("__to", F.floor(F.col("__part") / merge_batch)).groupBy(*names, "__to").applyInPandas(merged, level)
            n = -(-n // merge_batch)
        made = rows.drop("__part")
    else:

        def each(group: pd.DataFrame) -> pd.DataFrame:
            records = group.sort_values(order, kind="stable")[shown].to_dict("records")
            key = {k: group[k].iloc[0] for k in names}
            if not fold_batch or len(records) <= fold_batch:
                ok, _, out = call.run(main.render(inputs=records, reduce_key=key))
                return result(group, ok, out, [out])
            out, steps, ok = {}, [], True
            for k in range(0, len(records), fold_batch):  # the output so far is the fold's memory
                template = main if not k else fold
                good, _, new = call.run(template.render(inputs=records[k : k + fold_batch], output=out, reduce_key=key))
                ok, out = ok and good, new
                steps.append(new)
            return result(group, ok, out, steps)

        made = rows.groupBy(*names).applyInPandas(each, schema)
    return _beside(made.where("__ok").drop("__ok"), extra, names)


def _beside(made: DataFrame, extra: DataFrame, names: list[str]) -> DataFrame:
    if not names:
        return made.crossJoin(extra)  # one row each
    for k in names:
        extra = extra.withColumnRenamed(k, f"__{k}")
    return made.join(extra, [made[k].eqNullSafe(extra[f"__{k}"]) for k in names]).drop(*[f"__{k}" for k in names])
