"""Structured Streaming: row-local steps of a plan on a stream, and incremental folds with state.

Row-local operators compile to projections and filters and run on a stream as they are. Folds keep one small state per
key; a window with a watermark forgets what is late.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import Plan


def read_files(spark: SparkSession, path: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def apply(plan: Plan, stream: DataFrame) -> DataFrame:
    """The plan on a stream; every step must be row-local."""
    blocked = [n.name for n in plan.nodes if not n.traits.row_local]
    if blocked:
        raise ValueError(f"not row-local: {', '.join(blocked)}")
    return plan.compile(stream)


def windowed(stream: DataFrame, *, ts: str, width: str, late: str, keys: list[str], aggregates: dict, slide: str | None = None) -> DataFrame:
    """Aggregates per window and key; rows later than ``late`` are dropped."""
    stream = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stream.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def fold(stream: DataFrame, *, keys: list[str], state: str, output: str, step: Callable[[tuple | None, pd.DataFrame], tuple], finish: Callable[[tuple, tuple], dict]) -> DataFrame:
    """An incremental reduce: ``step(state or None, rows)`` gives the new state, ``finish(key, state)`` an output row."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def each(key, batches, held):
        now = held.get if held.exists else None
        for rows in batches:
            now = step(now, rows)
        held.update(now)
        yield pd.DataFrame([finish(key, now)])

    return stream.groupBy(*keys).applyInPandasWithState(each, output, state, "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> None:
    """Process what is there into Parquet, exactly once, and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "update") -> None:
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
