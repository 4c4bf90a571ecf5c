"""Split documents into chunks, and gather each chunk with its neighbours."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import strip


def split(df: DataFrame, key: str, *, name: str = "split", method: str = "delimiter", delimiter: str = "\n", group: int = 1, num_tokens: int = 100, tokenize: Callable[[str], list[str]] | None = None, id_of: list[str] | None = None) -> DataFrame:
    """A row per chunk: ``<key>_chunk``, ``<name>_id`` (one for each source row), ``<name>_chunk_num`` from 1.

    delimiter: blank pieces go, every ``group`` pieces are joined again and stripped. token_count: windows of
    ``num_tokens``; ``tokenize`` must give pieces that join to the text (default: words with the blanks before them).
    The id is a hash of the columns ``id_of`` (default: the key's).
    """
    if method == "delimiter":
        pieces = F.filter(F.split(F.col(key), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), lambda p: strip(p) != "")
        df = df.withColumn("__pieces", pieces).where(F.size("__pieces") > 0)
        last = F.floor((F.size("__pieces") - 1) / group).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda i: strip(F.array_join(F.slice(F.col("__pieces"), i * group + 1, group), delimiter)))
    elif method == "token_count":
        if tokenize is None:
            tokens = F.regexp_extract_all(F.col(key), F.lit(r"\s*\w+|\s*[^\w\s]|\s+$"), F.lit(0))
        else:

            def each(texts: pd.Series) -> pd.Series:
                return texts.map(lambda t: tokenize(t or ""))

            each.__annotations__ = {"texts": pd.Series, "return": pd.Series}
            tokens = F.pandas_udf(each, T.ArrayType(T.StringType()))(F.col(key))
        df = df.withColumn("__pieces", tokens).where(F.size("__pieces") > 0)
        last = F.floor((F.size("__pieces") - 1) / num_tokens).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(F.col("__pieces"), i * num_tokens + 1, num_tokens), ""))
    else:
        raise ValueError(f"unknown method: {method}")
    own = F.md5(F.concat_ws("\x01", F.lit(name), *[F.col(c).cast("string") for c in (id_of or [key])]).cast("binary"))
    kept = [c for c in df.columns if c != "__pieces"]
    df = df.select(*kept, own.alias(f"{name}_id"), F.posexplode(chunks).alias("__pos", f"{key}_chunk"))
    return df.withColumn(f"{name}_chunk_num", F.col("__pos") + 1).drop("__pos")


def _side(frame: Column, conf: dict | None, content_key: str) -> Column:
    """The rendered lines of one side; frame: its chunks in order, nearest context at the end it was built for."""
    if not conf:
        return F.array().cast("array<string>")
    n = F.size(frame)
    head, tail, middle = conf.get("head"), conf.get("tail"), conf.get("middle")
    heads = F.least(F.lit(int(head.get("count", 0))) if head else F.lit(0), n)
    tails = F.least(F.lit(int(tail.get("count", 0))) if tail else F.lit(0), n - heads)

    def lines(part: Column, section: dict | None) -> Column:
        own = (section or {}).get("content_key", content_key)
        label = " (Summary)" if own != content_key else ""
        return F.transform(part, lambda c: F.concat(F.lit("[Chunk "), c["__at"].cast("string"), F.lit(f"]{label} "), c[own]))

    between = F.slice(frame, heads + 1, F.greatest(n - heads - tails, F.lit(0)))
    if middle:
        mid = lines(between, middle)
    else:
        skipped = F.aggregate(between, F.lit(0).cast("long"), lambda a, c: a + F.length(c[content_key]))
        mid = F.when(F.size(between) > 0, F.array(F.concat(F.lit("[... "), skipped.cast("string"), F.lit(" characters skipped ...]")))).otherwise(F.array().cast("array<string>"))
    return F.concat(lines(F.slice(frame, F.lit(1), heads), head), mid, lines(F.slice(frame, n - tails + 1, tails), tail))


def _trail(frame: Column, current: Column) -> Column:
    """The last header of each level above the current chunk's own highest: ``# A > ## B``. Headers: {header, level}."""
    start = F.array().cast("array<struct<header:string,level:int>>")
    stack = F.aggregate(
        F.flatten(frame), start,
        lambda a, h: F.concat(F.filter(a, lambda x: x["level"] < h["level"]), F.array(F.struct(h["header"].cast("string").alias("header"), h["level"].cast("int").alias("level")))),
    )
    top = F.array_min(F.transform(current, lambda h: h["level"].cast("int")))
    above = F.filter(stack, lambda x: top.isNull() | (x["level"] < top))
    return F.array_join(F.transform(above, lambda x: F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["header"])), " > ")


def gather(df: DataFrame, *, content_key: str, doc_id_key: str, order_key: str, peripheral: dict | None = None, doc_header_key: str | None = None, main_start: str = "--- Begin Main Chunk ---", main_end: str = "--- End Main Chunk ---") -> DataFrame:
    """``<content_key>_rendered``: each chunk between what comes before and after it in its document.

    peripheral: {previous, next}, each {head, middle, tail} with ``count`` and ``content_key``; what no section takes is
    skipped and counted. Without peripherals and headers the chunk stays as it is.
    """
    if not peripheral and not doc_header_key:
        return df.withColumn(f"{content_key}_rendered", F.col(content_key))
    peripheral = peripheral or {}
    others = {s.get("content_key", content_key) for side in peripheral.values() for s in (side or {}).values()}
    chunk = F.struct(F.col(order_key).alias("__at"), *[F.col(c) for c in sorted({content_key, *others})])
    w = Window.partitionBy(doc_id_key).orderBy(order_key)
    frames = {"__before": (w.rowsBetween(Window.unboundedPreceding, -1), "previous"), "__after": (w.rowsBetween(1, Window.unboundedFollowing), "next")}
    df = df.withColumns({n: F.collect_list(chunk).over(f) for n, (f, side) in frames.items() if peripheral.get(side)})
    lines = [F.array(F.lit("--- Previous Context ---")), _side(F.col("__before"), peripheral["previous"], content_key), F.array(F.lit("--- End Previous Context ---\n"))] if peripheral.get("previous") else []
    if doc_header_key:
        df = df.withColumn("__headers", F.collect_list(doc_header_key).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        trail = _trail(F.col("__headers"), F.col(doc_header_key))
        lines.append(F.when(trail != "", F.array(F.concat(F.lit("_Current Section:_ "), trail))).otherwise(F.array().cast("array<string>")))
    lines += [F.array(F.lit(main_start), F.col(content_key), F.lit(main_end))]
    if peripheral.get("next"):
        lines += [F.array(F.lit("\n--- Next Context ---")), _side(F.col("__after"), peripheral["next"], content_key), F.array(F.lit("--- End Next Context ---"))]
    return df.withColumn(f"{content_key}_rendered", F.array_join(F.concat(*lines), "\n")).drop("__before", "__after", "__headers")
