"""A training-corpus pipeline: quality rules, near-dedup, benchmark decontamination, secret masking, packing.

Each stage's function takes (spark, docs, sf_dir); its result is written as Parquet into the shared folder and read
again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import shared_dir
from quillspark.llm.decontaminate import drop_contaminated
from quillspark.llm.near_dedup import keep_one
from quillspark.llm.packing import pack
from quillspark.llm.quality import keep_good
from quillspark.llm.secrets import mask_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A passage of the benchmark is a leak in a long document too, so its share doesn't matter."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_window=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark; n_chars follows."""
    masked = mask_secrets(docs)
    if "n_chars" not in masked.columns:
        return masked
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secrets), ("best_fit_packing", packing)]

#: Sketched thresholds, signatures and a tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
