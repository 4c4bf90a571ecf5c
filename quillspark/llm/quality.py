"""Quality rules with thresholds that adapt to each language and source.

Every document is measured once in NumPy. The measures are whole numbers in bounded ranges, so a histogram per
language, source and measure is a quantile sketch of bounded size that merges by addition, exactly and in any order.
Bounds are fences: a range between two quantiles of the group, or some times it, beyond them (``MEASURES``); quartiles
where junk may be frequent, the 98th percentile where most texts have nothing to count. A range counts as so many bins
at least. A group's quantiles are drawn towards those of all groups merged as if ``PRIOR`` documents more had been seen
there, so small groups have bounds too. Documents are then filtered against the bounds joined to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textkernels as K
from .common import bounded_batches, broadcast_if_small, materialize

#: measure: (last bin, two percentiles, how many times their range is allowed beyond them, its least number of bins,
#: whether there is a lower bound).
MEASURES = {"symbol_pm": (1000, 25, 75, 3, 10, False), "word_len_x10": (1000, 25, 75, 3, 8, True), "dup_line_pm": (1000, 50, 98, 1, 50, False), "repeat_pm": (1000, 50, 98, 1, 30, False)}
PRIOR = 20
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def _measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    starts, ends, first = K.word_bounds(data, offsets)
    n_words = np.diff(first)
    chars = K.row_sums(~K.SPACE[data] & ((data & 0xC0) != 0x80), offsets)
    symbols = K.row_sums(_SYMBOLS[data], offsets)
    # Lines: cut at line feeds and at the rows' ends; those without a word don't count.
    feeds = np.flatnonzero(data == 10)
    low = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    high = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    row = np.searchsorted(offsets[1:], high, "left") if not len(feeds) else np.cumsum(np.bincount(np.searchsorted(low, offsets[:-1], "left"), minlength=len(low))[: len(low)]) - 1
    full = np.searchsorted(starts, high, "left") > np.searchsorted(starts, low, "left") if len(starts) else np.zeros(len(low), bool)
    low, high, row = low[full], high[full], row[full]
    n_lines = np.bincount(row, minlength=len(n_words))
    keys = np.unique(K.mix(K.word_hashes(data, low, high) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    n_dup = n_lines - np.bincount(row[keys], minlength=len(n_words))
    # Words of five-word windows that occur twice or more in the text.
    repeats = np.zeros(len(n_words), np.int64)
    keys, row = K.windows(K.word_hashes(data, starts, ends), first, WINDOW)
    if len(keys):
        at = np.flatnonzero(np.concatenate([np.repeat(np.arange(len(n_words)), n_words)[: len(starts) - WINDOW + 1] == np.repeat(np.arange(len(n_words)), n_words)[WINDOW - 1 :]]))
        keys = K.mix(keys + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        depth = np.zeros(len(starts) + 1, np.int32)
        depth[at[twice]] += 1
        depth[at[twice] + WINDOW] -= 1
        repeats = K.row_sums(np.cumsum(depth)[:-1] > 0, first)
    return [n_words, chars, symbols, n_lines, n_dup, repeats]


def with_metrics(rows: DataFrame, text: str, drop_text: bool) -> DataFrame:
    """``rows`` with the columns of ``METRICS`` (prefixed ``__``); a null text counts as empty."""
    kept = [f for f in rows.schema.fields if not (drop_text and f.name == text)]
    schema = T.StructType([*kept, *[T.StructField(f"__{m}", T.LongType()) for m in METRICS]])
    names = [f.name for f in kept]

    bounded_batches(rows.sparkSession)
    def run(batches):
        for batch in K.slices(batches, text):
            found = _measure(*K.buffer_of(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array(x, pa.int64()) for x in found]], names=[*names, *[f"__{m}" for m in METRICS]])

    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("__n_words") < 10) | (100 * F.col("__n_repeat_words") > 20 * F.col("__n_words"))


def measures() -> dict[str, Column]:
    ratio = lambda scale, a, b: F.when(F.col(b) > 0, F.floor(F.lit(scale) * F.col(a) / F.col(b))).otherwise(0)
    found = {"symbol_pm": ratio(1000, "__n_symbols", "__word_chars"), "word_len_x10": ratio(10, "__word_chars", "__n_words"), "dup_line_pm": ratio(1000, "__n_dup_lines", "__n_lines"), "repeat_pm": ratio(1000, "__n_repeat_words", "__n_words")}
    return {k: F.least(v, F.lit(MEASURES[k][0])).cast("int") for k, v in found.items()}


def sketch(measured: DataFrame, lang: str, source: str) -> DataFrame:
    """The histogram of each measure by language and source: lang, source, m, bin, n."""
    each = F.array(*[F.struct(F.lit(k).alias("m"), v.alias("bin")) for k, v in measures().items()])
    return measured.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(each).alias("e")).groupBy("lang", "source", "e.m", "e.bin").agg(F.count("*").alias("n"))


def _quantiles(hist: DataFrame, by: list[str]) -> DataFrame:
    """The percentiles of each measure, a row for each group: <measure>_a, <measure>_b, n_docs."""
    w = Window.partitionBy(*by, "m")
    cum = hist.select("*", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("all"))
    quantile = lambda k, q, name: F.min(F.when((F.col("m") == k) & (F.col("upto") * 100 >= F.col("all") * q), F.col("bin"))).alias(f"{k}_{name}")
    return cum.groupBy(*by).agg(F.max("all").alias("n_docs"), *[quantile(k, MEASURES[k][i], name) for k in MEASURES for i, name in ((1, "a"), (2, "b"))])


def thresholds(hist: DataFrame) -> DataFrame:
    """A row per (lang, source) with its bounds: <measure>_low, <measure>_high."""
    own = _quantiles(hist, ["lang", "source"])
    merged = _quantiles(hist.groupBy("m", "bin").agg(F.sum("n").alias("n")).withColumn("all_groups", F.lit(1)), ["all_groups"]).drop("n_docs", "all_groups")
    merged = F.broadcast(merged.select(*[F.col(c).alias(f"any_{c}") for c in merged.columns]))  # one row
    drawn = lambda c: (F.col(c) * F.col("n_docs") + F.col(f"any_{c}") * PRIOR) / (F.col("n_docs") + PRIOR)
    out = []
    for k, (_, _, _, times, least, lower) in MEASURES.items():
        reach = times * F.greatest(drawn(f"{k}_b") - drawn(f"{k}_a"), F.lit(float(least)))
        out += [(drawn(f"{k}_a") - reach if lower else F.lit(-1.0)).alias(f"{k}_low"), (drawn(f"{k}_b") + reach).alias(f"{k}_high")]
    return own.join(merged, F.lit(True)).select("lang", "source", *out)


def judged(measured: DataFrame, hist: DataFrame, lang: str, source: str) -> DataFrame:
    """``measured`` with ``__base_failed`` and ``__kept``; the caller's columns may have any other names."""
    mark = lambda c: F.col(f"bounds.{c}")
    bounds = thresholds(hist)
    bounds = broadcast_if_small(materialize(bounds, "quality-bounds"), 100_000).select(F.struct("*").alias("bounds"))
    fits = F.lit(True)
    for k, v in measures().items():
        fits = fits & F.coalesce(v.between(mark(f"{k}_low"), mark(f"{k}_high")), F.lit(True))
    cols = [F.col(f"`{c}`") for c in measured.columns]
    joined = measured.select(F.struct(*cols).alias("row"), F.col(lang).alias("of_lang"), F.col(source).alias("of_source"), base_failed().alias("failed"), *[F.col(f"__{m}") for m in METRICS])
    joined = joined.join(bounds, F.col("of_lang").eqNullSafe(mark("lang")) & F.col("of_source").eqNullSafe(mark("source")), "left")
    return joined.select("row.*", F.col("failed").alias("__base_failed"), (~F.col("failed") & fits).alias("__kept"))


def judged(measured: DataFrame, hist: DataFrame, lang: str, source: str) -> DataFrame:
    """``measured`` with ``__base_failed`` and ``__kept``."""
    bounds = broadcast_if_small(materialize(thresholds(hist).withColumnsRenamed({"lang": "__lang", "source": "__source"}), "quality-bounds"), 100_000)
    fits = F.lit(True)
    for k, v in measures().items():
        fits = fits & F.coalesce(v.between(F.col(f"{k}_low"), F.col(f"{k}_high")), F.lit(True))
    joined = measured.join(bounds, F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    return joined.select(*[F.col(c) for c in measured.columns], base_failed().alias("__base_failed"), (~base_failed() & fits).alias("__kept"))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Measure and judge every document: doc_id, the metrics, base_failed, kept.

    A null or empty text has no words and fails. A null language or source is a group of its own. Ids may be null or
    repeat: rows are judged one by one. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    measured = materialize(with_metrics(rows, "text", drop_text=True), "quality-metrics")
    hist = materialize(sketch(measured, "lang", "source"), "quality-sketch")
    out = judged(measured, hist, "lang", "source")
    return out.select("doc_id", *[F.col(f"__{m}").alias(m) for m in METRICS], F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that the rules keep, with all their columns. Texts are measured twice rather than shuffled.

    Null and empty texts go, a null language or source is a group of its own, repeated rows are judged alike; columns
    of any name pass through as they are; an empty table gives no rows.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the caller's are
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    plain = docs.toDF(*names)
    text, lang, source = at[text_col], at[lang_col], at[source_col]
    hist = materialize(sketch(with_metrics(plain.select(text, lang, source), text, drop_text=True), lang, source), "quality-sketch")
    return judged(with_metrics(plain, text, drop_text=False), hist, lang, source).where("__kept").select(*names).toDF(*docs.columns)
