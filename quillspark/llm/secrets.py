"""Secret scan: base patterns, and multipart credentials linked by an interval join.

Three kinds are secrets by themselves: ``assign``, ``access`` and ``hex``. Weaker candidates are the parts of a
credential that spans several places: an identifier, a secret-looking value, an endpoint. Such a part counts only where
a complementary part (another of the three) lies within the same scope, a distance in code points, and doesn't overlap
it. Base secrets complement weak parts too (``ROLE``). That band join runs as range frames over each document's parts,
never as pairs. Positions come from splitting a text at its matches:
lengths of pieces and matches alternate. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, row_key

#: kind: (pattern, group that must be long enough, its least length, a pattern that a good match contains, a cheaper
#: pattern that any text with a good match contains). Runs of one class are matched whole either way, so the least
#: length of ``access`` and ``hex`` stands in the pattern.
BASE = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, None, r"""[DdTtNnYy]["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20, None, r"AKIA[A-Z0-9]{16}"),
    "hex": (r"[0-9a-f]{24,}", 0, 24, None, r"[0-9a-f]{24}"),
}
PARTS = {
    "ident": (r"""([Uu][Ss][Ee][Rr]_?[Nn][Aa][Mm][Ee]|[Uu][Ss][Ee][Rr]|[Ll][Oo][Gg][Ii][Nn]|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy]_?[Ii][Dd]|[Aa][Cc][Cc][Ee][Ss][Ss]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""", 0, 1, None, r"""[A-Za-z]["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3}"""),
    "value": (r"[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32, r"[0-9]", r"[A-Za-z0-9+/_-]{32}"),
    "endpoint": (r"""(https|http|ftp|s3|postgres|mysql|mongodb)://[^\x00-\x20"'<>]{4,}""", 0, 1, None, r"://"),
}
#: What a span is to the weak parts around it: an access key is an identifier, other base secrets are values.
ROLE = {"access": "ident", "assign": "value", "hex": "value", **{k: k for k in PARTS}}
SCOPE = 400


def spans(text: Column, kind: str, pattern: str, group: int, least: int, must: str | None, contains: str) -> Column:
    """The matches' (start, end, kind) in code points; failing matches are dropped, texts without ``contains`` skipped."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    good = lambda h, p: F.when((F.length(p) >= least) & (h.rlike(must) if must else F.lit(True)), 1).otherwise(0)
    if group:
        hits = F.zip_with(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda h, p: F.struct(F.length(h).alias("n"), good(h, p).alias("ok")))
    else:
        hits = F.transform(hits, lambda h: F.struct(F.length(h).alias("n"), good(h, h).alias("ok")))
    # One piece more than matches: the last has no match after it.
    found = F.zip_with(F.split(text, pattern), hits, lambda g, h: F.struct(F.length(g).alias("gap"), h["n"].alias("n"), h["ok"].alias("ok")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    end = lambda a, x: a["at"] + x["gap"] + x["n"]
    walk = F.aggregate(
        found,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.when(x["n"].isNull(), a).otherwise(
            F.struct(
                end(a, x).alias("at"),
                F.when(x["ok"] == 1, F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), end(a, x).alias("end"), F.lit(kind).alias("kind"))))).otherwise(a["out"]).alias("out"),
            )
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(contains), walk).otherwise(none)


_RANK = {k: i for i, k in enumerate((*BASE, *PARTS))}


def in_order(found: Column) -> Column:
    """By start, then kind as listed, then end."""
    rank = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), s["kind"])
    keyed = F.transform(found, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_spans(docs: DataFrame, *, id_col: str, text_col: str, scope: int = SCOPE) -> DataFrame:
    """doc_id, rid, base and linked (arrays of start, end, kind), one row for each distinct id and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("rid"), text.alias("text"))
    rows = rows.select("doc_id", "rid", *[spans(F.col("text"), k, *v).alias(k) for k, v in (BASE | PARTS).items()])
    # Only spans of two roles or more can complement each other, and only weak parts gain by it; the others end here.
    any_of = lambda kinds: sum((F.size(k) for k in kinds), F.lit(0)) > 0
    roles = sum((any_of([k for k in ROLE if ROLE[k] == role]).cast("int") for role in PARTS), F.lit(0))
    rows = rows.select("doc_id", "rid", F.concat(*BASE).alias("base"), F.when((roles > 1) & any_of(PARTS), F.concat(*PARTS)).alias("parts"))
    rows = materialize(rows, "secret-rows")
    parts = rows.where("parts is not null").dropDuplicates(["doc_id", "rid"]).select("doc_id", "rid", F.explode(F.concat("base", "parts")).alias("s")).select("doc_id", "rid", "s.start", "s.end", "s.kind")
    role = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv]), F.col("kind"))
    parts = parts.withColumn("role", role)
    w = Window.partitionBy("doc_id", "rid").orderBy("start")
    before, after = w.rangeBetween(-scope, 0), w.rangeBetween(0, scope)
    other = F.lit(False)
    for k in PARTS:  # the earliest end before a part and the latest start after it tell whether any lies apart from it
        own = F.col("role") == k
        apart = (F.min(F.when(own, F.col("end"))).over(before) <= F.col("start")) | (F.max(F.when(own, F.col("start"))).over(after) >= F.col("end"))
        other = other | (~own & F.coalesce(apart, F.lit(False)))
    linked = parts.select("doc_id", "rid", "start", "end", "kind", other.alias("linked")).where("linked").where(F.col("kind").isin(*PARTS))
    linked = linked.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("start", "end", "kind")).alias("linked"))
    linked = materialize(linked.withColumnsRenamed({"doc_id": "__d", "rid": "__r"}), "secret-links")
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("rid") == F.col("__r"))
    return rows.join(linked, same, "left").select("doc_id", "rid", "base", F.coalesce("linked", F.array().cast("array<struct<start:int,end:int,kind:string>>")).alias("linked"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """The secrets of every document: doc_id, base, linked and spans, ordered arrays of (start, rank, end, kind).

    A null text counts as empty. Ids may be null or repeat, and so may rows: each gets its result. Other columns are
    ignored; an empty table gives no rows. Very long texts are scanned whole.
    """
    found = find_spans(docs, id_col=id_col, text_col=text_col, scope=scope)
    return found.select("doc_id", in_order(F.col("base")).alias("base"), in_order(F.col("linked")).alias("linked"), in_order(F.concat("base", "linked")).alias("spans"))


def masked(text: Column, found: Column, mask: str) -> Column:
    """The text with the union of ordered spans replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    walk = F.aggregate(
        found, start,
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask))).alias("out"),
            )
        ),
        lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1)),
    )
    return F.when(F.size(found) > 0, walk).otherwise(text)


def mask_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The documents with all their columns and rows; secrets in the text give way to ``mask``.

    Only documents with secrets, by their keys, are joined; a null text stays null.
    """
    found = scan_rows = find_spans(docs, id_col=id_col, text_col=text_col, scope=scope)
    found = scan_rows.select(F.col("doc_id").alias("__d"), F.col("rid").alias("__r"), in_order(F.concat("base", "linked")).alias("__spans")).where(F.size("__spans") > 0).dropDuplicates(["__d", "__r"])
    found = materialize(found, "secret-masks")
    rows = docs.withColumn("__rid", row_key(F.col(id_col), F.col(text_col)))
    rows = rows.join(found, F.col(id_col).eqNullSafe(F.col("__d")) & (F.col("__rid") == F.col("__r")), "left")
    text = F.when(F.col("__spans").isNotNull(), masked(F.col(text_col), F.col("__spans"), mask)).otherwise(F.col(text_col))
    return rows.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
