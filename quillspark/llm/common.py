"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows that may be broadcast: above it, the callers keep a shuffled join.
BROADCAST_ROWS = 500_000
#: Text that one Arrow batch takes to a Python worker, about.
BATCH_BYTES = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one only in local mode without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def bounded_batches(spark: SparkSession) -> None:
    """Hold the Arrow batches that go to Python workers to a few megabytes (their default bound is a count of rows)."""
    found = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB")
    if found.lstrip("-").isdigit() and not 0 < int(found) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder, a folder for each value of ``by``, and read it again: cuts the
    lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}/{tag}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` made and that no later job reads, and let the driver's JVM collect what
    it holds of them: the shuffle files of finished jobs go with it."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.__dict__["stored_at"])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a materialized ``df`` for broadcast if it has at most ``rows`` rows, else leave it to a shuffled join.

    At most ``rows + 1`` rows are counted.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is. Pure ASCII texts take the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def row_key(*columns: Column) -> Column:
    """A 64-bit key of a row's identity, for joins beside the id itself (ids may repeat or be null)."""
    return F.xxhash64(*columns)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have, whatever the case."""
    taken, name = {c.lower() for c in df.columns}, f"__{stem}"
    while name in taken:
        name += "_"
    return name


def doubling(total: int) -> list[int]:
    """Shifts that grow a window of 1 to ``total`` by overlapping doubling: each shift is at most the size so far."""
    out, size = [], 1
    while size < total:
        out.append(shift := min(size, total - size))
        size += shift
    return out
