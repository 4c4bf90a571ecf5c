"""Reading and writing collections; every source has an ordinal column on request."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORD = "__ord"


def with_ordinal(df: DataFrame, files: bool = True) -> DataFrame:
    """Parquet rows by file and place; other sources by the order that partitions are read in."""
    if files:
        return df.withColumn(ORD, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return df.withColumn(ORD, F.monotonically_increasing_id())


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds one array of objects (or one object per line, ``.jsonl``)."""
    return spark.read.option("multiLine", not path.endswith((".jsonl", ".ndjson"))).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header; all values are strings."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """path, filename, text of every file below ``path``; hidden and binary files (a zero in the first KiB) are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    plain = F.locate("00 ", F.regexp_replace(F.hex(F.substring("content", 1, 1024)), "(..)", "$1 ")) == 0
    return files.where(~name.startswith(".") & plain).select("path", name.alias("filename"), F.decode("content", "UTF-8").alias("text"))


def from_rows(spark: SparkSession, rows: list[dict], schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of dicts; keys missing in some are null there."""
    if not rows and schema is None:
        return spark.range(1).select()
    if schema is None:
        names = list(dict.fromkeys(k for r in rows for k in r))
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names, samplingRatio=1.0)
    return spark.createDataFrame(rows, schema)


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By the path's ending: .json, .csv or .parquet. A folder of part files, as Spark writes."""
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("json", "csv", "parquet"):
        raise ValueError("an output is a .json, .csv or .parquet path")
    writer = df.write.mode(mode)
    if kind == "csv":
        nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
        df.withColumns({n: F.to_json(n) for n in nested}).write.mode(mode).csv(path, header=True, escape='"')
    else:
        getattr(writer, kind)(path)


PARSERS: dict[str, Callable] = {}


def parser(function: Callable) -> Callable:
    """Register a parsing tool: one value to a list of strings."""
    PARSERS[function.__name__] = function
    return function


@parser
def txt_to_string(value: str) -> list[str]:
    return [value]


@parser
def csv_to_rows(value: str) -> list[str]:
    import csv
    import io

    return [json.dumps(r) for r in csv.DictReader(io.StringIO(value))]


def _office(value: bytes, member: str, tag: str) -> list[str]:
    """The texts of an Office Open XML archive's parts, by part name."""
    import io
    import re
    import zipfile
    from xml.etree import ElementTree

    out = []
    with zipfile.ZipFile(io.BytesIO(value)) as z:
        for name in sorted((n for n in z.namelist() if re.fullmatch(member, n)), key=lambda n: (len(n), n)):
            root = ElementTree.fromstring(z.read(name))
            paragraphs = ["".join(t.text or "" for t in p.iter() if t.tag.endswith("}t")) for p in root.iter() if p.tag.endswith(tag)]
            out.append("\n".join(paragraphs))
    return out


@parser
def docx_to_string(value: bytes) -> list[str]:
    return _office(value, r"word/document\.xml", "}p")


@parser
def pptx_to_string(value: bytes) -> list[str]:
    """A text per slide."""
    return _office(value, r"ppt/slides/slide\d+\.xml", "}p")


@parser
def xlsx_to_string(value: bytes) -> list[str]:
    return ["\n".join(_office(value, r"xl/sharedStrings\.xml", "}si"))]


def _parsing(f: Callable):
    import pandas as pd

    def each(values: pd.Series) -> pd.Series:
        return values.map(f)

    each.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, T.ArrayType(T.StringType()))


def parse(df: DataFrame, tools: list[dict]) -> DataFrame:
    """Apply parsing tools in turn: each makes a row per result, in order, with ``output_key`` set.

    tools: {function: name or callable, input_key, output_key}. A name is one of ``PARSERS``.
    """
    for tool in tools:
        f = tool["function"] if callable(tool["function"]) else PARSERS[tool["function"]]

        column = _parsing(f)
        df = df.withColumn(tool["output_key"], F.explode(column(F.col(tool["input_key"]))))
    return df


class Checkpoints:
    """Results by the hash of everything that led to them; a hit makes the steps before it unnecessary."""

    def __init__(self, folder: str):
        self.folder = folder

    def path(self, step: str, digest: str) -> str:
        return f"{self.folder}/{step}/{digest}"

    def get(self, spark: SparkSession, step: str, digest: str) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path(step, digest) + "/_SUCCESS")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.parquet(self.path(step, digest))

    def put(self, df: DataFrame, step: str, digest: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(step, digest))
        return df.sparkSession.read.schema(df.schema).parquet(self.path(step, digest))


def fresh(folder: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}"
