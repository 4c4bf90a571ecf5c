"""Benchmark decontamination by winnowing.

The hash of every k-gram of words is taken, and in every window of ``span - k + 1`` neighbouring k-grams the least one
is kept as a fingerprint. A document and an item that share ``span`` words in a row share a whole window and with it
its fingerprint, so none is missed. Documents whose fingerprints meet the benchmark's are then extended exactly: each of
their ``span``-word windows is compared with the items' windows. An item shorter than ``span`` words is one window of
its own length; such lengths are looked up by the hash of every n-gram of that length. All of it is built-in functions:
hashes, rolling combinations (``zip_with`` over shifted arrays, doubling) and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, doubling, materialize, row_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, GRAM = 13, 4


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _rolled(df: DataFrame, name: str, total: int, pair) -> DataFrame:
    """The array column folded over each window of ``total`` elements by doubling.

    Every step is a projection of its own: an array that is used twice is then computed once.
    """
    for shift in doubling(total):
        left = F.slice(name, 1, F.greatest(F.size(name) - shift, F.lit(0)))
        df = df.withColumn(name, F.zip_with(left, F.slice(name, shift + 1, F.size(name)), pair))
    return df


def with_fingerprints(df: DataFrame, name: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The array of word hashes becomes that of its fingerprints: the least k-gram hash of each window, each once."""
    df = _rolled(df, name, gram, lambda x, y: F.xxhash64(x, y))
    return _rolled(df, name, span - gram + 1, lambda x, y: F.least(x, y)).withColumn(name, F.array_distinct(name))


def _ngrams(w: Column, n: Column | int) -> Column:
    """(at, key) of every n words in a row; at counts from 1. The key is 128 bits of the words themselves."""
    n = F.lit(n) if isinstance(n, int) else n
    at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.md5(F.array_join(F.slice(w, i, n), " ").cast("binary")).alias("key")))


def _whole_grams(w: Column, n: int) -> Column:
    """(n, f) of every n words in a row, each once."""
    at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.array_join(F.slice(w, i, n), " ")).alias("f"))))


def match(docs: DataFrame, benchmark: DataFrame, *, id_col: str, text_col: str, item_col: str, item_text_col: str, span: int = SPAN, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): rows has doc_id, rid, n_words for every document; hits has doc_id, rid, n_hit, n_items, items, by_span (by a window of ``span`` words) for those hit."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), words(F.col(item_text_col)).alias("w")).where(F.size("w") > 0)
    items = materialize(items.where("item is not null").dropDuplicates(), "benchmark-items")
    # An item's windows: those of ``span`` words, or the item itself.
    length = F.least(F.size("w"), F.lit(span))
    keyed = items.select("item", length.alias("n"), F.explode(_ngrams(F.col("w"), length)).alias("g")).select("item", "n", F.col("g.key").alias("key"))
    keyed = broadcast_if_small(materialize(keyed.groupBy("n", "key").agg(F.collect_set("item").alias("items")), "benchmark-windows"))
    hashed = F.transform("w", lambda x: F.xxhash64(x))
    short = sorted(r[0] for r in items.where(F.size("w") < span).select(F.size("w")).distinct().collect())
    prints = with_fingerprints(items.where(F.size("w") >= span).select(hashed.alias("f")), "f", span, gram)
    # The outer form: Spark would push a plain explode's filter on the size through every step, copying the arrays' expression.
    prints = prints.select(F.lit(span).alias("n"), F.explode_outer("f").alias("f")).where("f is not null")
    prints = prints.union(items.where(F.size("w") < span).select(F.size("w").alias("n"), F.xxhash64(F.array_join("w", " ")).alias("f"))).distinct()
    prints = broadcast_if_small(materialize(prints, "benchmark-prints"))

    base = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("rid"), F.col(text_col).alias("text"))
    split = base.select("doc_id", "rid", words(F.col("text")).alias("w"))
    # One pass over all texts: the words' number, and a row per fingerprint to join with the benchmark's.
    found = [F.transform("f", lambda f: F.struct(F.lit(span).alias("n"), f.alias("f")))]
    found += [_whole_grams(F.col("w"), n) for n in short]
    rows = with_fingerprints(split.select("doc_id", "rid", *(["w"] if short else []), F.size("w").alias("n_words"), hashed.alias("f")), "f", span, gram)
    rows = rows.select("doc_id", "rid", "n_words", (F.flatten(F.array(*found)) if short else found[0]).alias("found"))
    rows = rows.select("doc_id", "rid", "n_words", F.explode_outer("found").alias("p")).select("doc_id", "rid", "n_words", F.col("p.n").alias("pn"), F.col("p.f").alias("pf"))
    rows = rows.join(prints.withColumn("suspect", F.lit(1)), (F.col("pn") == F.col("n")) & (F.col("pf") == F.col("f")), "left")
    rows = materialize(rows.groupBy("doc_id", "rid", "n_words").agg(F.max("suspect").alias("suspect")), "decontaminate-rows")
    suspects = broadcast_if_small(materialize(rows.where("suspect = 1").select("doc_id", "rid"), "decontaminate-suspects"))
    # Extension: every window of the suspects against the items' windows.
    again = base.join(suspects.withColumnsRenamed({"doc_id": "__d", "rid": "__r"}), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("rid") == F.col("__r")), "left_semi")
    again = again.select("doc_id", "rid", words(F.col("text")).alias("w"))
    grams = again.select("doc_id", "rid", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), _ngrams(F.col("w"), n).alias("g")) for n in (*short, span)])).alias("x"))
    grams = grams.select("doc_id", "rid", "x.n", F.explode("x.g").alias("g")).select("doc_id", "rid", "n", "g.at", "g.key")
    met = grams.join(keyed, ["n", "key"]).groupBy("doc_id", "rid").agg(F.collect_set(F.struct("at", "n")).alias("spots"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spots", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    hits = met.select("doc_id", "rid", F.size(covered).cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), F.exists("spots", lambda s: s["n"] == span).alias("by_span"))
    return rows.drop("suspect"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", **options) -> DataFrame:
    """How much of each document is benchmark text: doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    A null text, of a document or an item, has no words; an item without words or without an id has no windows. Ids
    may be null or repeat, and so may rows: each gets its result. Other columns are ignored; an empty table of
    documents gives no rows, an empty benchmark hits nothing. ``contaminated``: a twentieth of the words or more are hit.
    """
    rows, hits = match(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, **options)
    hits = materialize(hits.drop("by_span").withColumnsRenamed({"doc_id": "__d", "rid": "__r"}), "decontaminate-hits")
    copies = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("rid"))
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("rid") == F.col("__r"))
    rows = copies.join(rows.select(F.col("doc_id").alias("__d"), F.col("rid").alias("__r"), "n_words"), same).drop("__d", "__r")
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("rid") == F.col("__r")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", any_window: bool = False, **options) -> DataFrame:
    """The documents that aren't contaminated, with all their columns and rows; texts are not shuffled unless very many are.

    With ``any_window`` one window of ``span`` words is enough, however long the document; items of fewer words, which
    may be common phrases, still count by their share only.
    """
    rows, hits = match(docs, benchmark, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col, **options)
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("rid") == F.col("__r"))
    hits = hits.withColumnsRenamed({"doc_id": "__d", "rid": "__r"})
    leaks = 20 * F.col("n_hit") >= F.col("n_words")
    found = rows.join(hits, same).where(leaks | F.col("by_span") if any_window else leaks).select("__d", "__r")
    found = broadcast_if_small(materialize(found, "contaminated"))
    keyed = docs.withColumn("__rid", row_key(F.col(id_col), F.col(text_col)))
    return keyed.join(found, F.col(id_col).eqNullSafe(F.col("__d")) & (F.col("__rid") == F.col("__r")), "left_anti").select(*docs.columns)
