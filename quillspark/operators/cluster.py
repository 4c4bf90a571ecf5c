"""Hierarchical clustering: a Ward tree with a summary for each node, as a path of ancestors on every row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one tree; larger inputs are bucketed by k-means first and the tree is built over the bucket centres.
LARGEST = 2000


def ward(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, height) in order of height; node n+k is the k-th merge. Nearest-neighbour chain."""
    n = len(x)
    centre, size = {i: x[i] for i in range(n)}, dict.fromkeys(range(n), 1)
    chain, merges = [], []

    def gap(a, b):
        d = centre[a] - centre[b]
        return size[a] * size[b] / (size[a] + size[b]) * float(d @ d)

    nxt = n
    while len(centre) > 1:
        if not chain:
            chain.append(min(centre))
        while True:
            a = chain[-1]
            last = chain[-2] if len(chain) > 1 else None
            b = min((k for k in centre if k != a), key=lambda k: (gap(a, k), k != last, k))
            if b == last:
                break
            chain.append(b)
        chain = chain[:-2]
        merges.append((min(a, b), max(a, b), (2 * gap(a, b)) ** 0.5, nxt))
        centre[nxt] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
        size[nxt] = size[a] + size[b]
        for k in (a, b):
            del centre[k], size[k]
        nxt += 1
    # By height, renumbered.
    order = sorted(range(len(merges)), key=lambda i: (merges[i][2], i))
    name = {merges[i][3]: n + k for k, i in enumerate(order)}
    return [(name.get(merges[i][0], merges[i][0]), name.get(merges[i][1], merges[i][1]), merges[i][2]) for i in order]


def paths(x: np.ndarray, collapse: float | None = None) -> tuple[list[list[int]], dict[int, list[int]]]:
    """(ancestors of each row, nearest first; children of each inner node). ``collapse`` merges a node into its parent if
    its height is at least that share of the parent's."""
    n = len(x)
    if n < 2:
        return [[] for _ in range(n)], {}
    merges = ward(x)
    children = {n + k: [a, b] for k, (a, b, _) in enumerate(merges)}
    height = {n + k: h for k, (_, _, h) in enumerate(merges)}
    if collapse is not None:
        for node in sorted(children, reverse=True):
            changed = node in children
            while changed:
                changed = False
                for c in list(children[node]):
                    if c in children and height[c] >= collapse * height[node]:
                        at = children[node].index(c)
                        children[node][at : at + 1] = children.pop(c)
                        changed = True
    parent = {c: p for p, cs in children.items() for c in cs}
    out = []
    for i in range(n):
        up, path = i, []
        while up in parent:
            up = parent[up]
            path.append(up)
        out.append(path)
    return out, children


def cluster(df: DataFrame, *, vector: str, order: list[str], text: str, summarize: Callable[[list[str]], str], output_key: str = "clusters", collapse: float | None = None) -> DataFrame:
    """``output_key``: summaries of a row's ancestors, nearest first; a node's is made of its children's, bottom up.

    A tree is global and quadratic, so it is built over at most ``LARGEST`` points in one task: the rows themselves, or
    the centres of as many k-means buckets (an approximation for larger inputs; all rows of a bucket share a path).
    """
    schema = T.StructType([*df.select(*order).schema.fields, T.StructField(output_key, T.ArrayType(T.StringType()))])

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable").reset_index(drop=True)
        up, children = paths(np.array(rows["__v"].tolist(), float).reshape(len(rows), -1), collapse)
        said: dict[int, str] = dict(enumerate(rows["__t"]))
        for node in sorted(children):
            said[node] = summarize([said[c] for c in children[node]])
        rows[output_key] = [[said[a] for a in path] for path in up]
        return rows[schema.names]

    points = df.select(*order, F.col(vector).alias("__v"), F.col(text).alias("__t"))
    if df.limit(LARGEST + 1).count() <= LARGEST:
        made = points.groupBy().applyInPandas(tree, schema)
        return df.join(F.broadcast(made), order, "left")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("__f", array_to_vector(F.transform(vector, lambda v: v.cast("double"))))
    fitted = KMeans(k=LARGEST // 4, seed=42, featuresCol="__f", predictionCol="__bucket").fit(rows)
    rows = fitted.transform(rows).drop("__f")
    heads = rows.groupBy("__bucket").agg(F.min_by(text, F.struct(*order)).alias("__t"))
    centres = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(fitted.clusterCenters())], "__bucket int, __v array<double>")
    over = T.StructType([T.StructField("__bucket", T.IntegerType()), schema[output_key]])

    def over_buckets(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("__bucket").reset_index(drop=True)
        up, children = paths(np.array(part["__v"].tolist(), float), collapse)
        said = dict(enumerate(part["__t"]))
        for node in sorted(children):
            said[node] = summarize([said[c] for c in children[node]])
        part[output_key] = [[said[a] for a in path] for path in up]
        return part[over.names]

    made = centres.join(heads, "__bucket").groupBy().applyInPandas(over_buckets, over)
    return rows.join(F.broadcast(made), "__bucket", "left").drop("__bucket")
