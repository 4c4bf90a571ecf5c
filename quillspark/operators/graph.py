"""Connected components by contraction."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the folder that the executors share (``spark.checkpoint.dir``) and read again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="quillspark-"))
    path = f"{folder}/quillspark/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node of each component, for every node that has an edge.

    In each round every node moves to the neighbour of least seeded rank (or stays) and edges between the images remain:
    a constant share of the nodes goes each time, on chains and on stars. Joins are equi-joins, so skew is split by AQE.
    """
    edges = stored(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    moved, step = None, 0
    while not edges.isEmpty():
        step += 1
        best = F.least(*[F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("r"), F.col(c).alias("to")) for c in ("a", "b")])
        ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), best.alias("best")), F.struct(F.col("b").alias("node"), best.alias("best")))))
        to = stored(ends.groupBy("node").agg(F.min("best")["to"].alias("to")))
        left, right = (to.select(F.col("node").alias(c), F.col("to").alias(f"r{c}")) for c in ("a", "b"))
        edges = stored(edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if moved is None:
            moved = to.withColumnRenamed("to", "root")
        else:
            moved = stored(moved.join(to.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    if moved is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    least = moved.groupBy("root").agg(F.min("node").alias("least"))
    return moved.join(least, "root").select("node", F.col("least").alias("root"))
