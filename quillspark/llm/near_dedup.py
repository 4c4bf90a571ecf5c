"""Near-duplicate documents by BagMinHash, banding and verified multiset overlap.

A document is a bag of five-word shingles (A-Z lower-cased, words between ASCII white space; a text of fewer words is
one shingle). Each shingle owns Poisson processes over the ranges of weight (0,1], (1,2], (2,4], (4,8] ...; a point of a
process counts for a document whose shingle weighs at least the point's own weight. A signature component holds the
first point that falls to it, so two documents agree in a component with probability equal to their weighted Jaccard
similarity, and the work stops once no later point can matter. Signatures are cut into bands; documents that share a
band are compared by their bags of shingles.

Equal texts are collapsed before anything is signed. Buckets are not expanded into pairs. Each bucket's pivot is the
member that shares most buckets with others, which is the same one, near the group's middle, for nearly all buckets of
a group of copies; the others are compared with it. What that leaves open is decided by exact bounds against the pivot
p (c: units shared with p, n: units):

* a member less similar than 2t-1 to p can't be similar to one that p is linked to (the distance is a metric);
* two other members share at most min(c, c') units of p, so a link needs a unit that both have and p has not, or
  min(c, c') (1+t) >= t (n+n'). Members go on in a bucket for each unit that they have and p has not, and in one more
  if the second condition can hold for them; a bucket within one class is finished.

So rows are bounded by the members and the units by which they differ from their pivot, and a bucket of copies with
edits of their own falls apart at once. Members far from the pivot (chance collisions of a band), and those of the
buckets that follow, meet the others by a join on the bucket, which only passes on those whose signatures allow the
similarity within five standard deviations (three links in ten million are lost by that); large buckets are dealt over
tasks. Pivots are taken once only: in what follows none is near the middle, so each further one would settle few of its
bucket's members, in ever more steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernels as K
from .common import bounded_batches, broadcast_if_small, discard, materialize, unused

SHINGLE = 5
BANDS, ROWS = 40, 8
#: Least weighted Jaccard similarity, in hundredths.
SIMILAR = 80
#: Rows of one pivot or one text beyond which they are spread over tasks.
HOT = 5_000
#: Units of one pivot's members beyond which they are spread over tasks.
HOT_UNITS = 4_000_000
#: Members of a bucket, with all of which one of them is compared, beyond which it is spread over tasks.
SMALL = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row) of each row's shingles."""
    data = K.LOWER[data]
    starts, ends, first = K.word_bounds(data, offsets)
    hashes = K.word_hashes(data, starts, ends)
    keys, row = K.windows(hashes, first, SHINGLE)
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(SHINGLE - 1):
            at = first[few] + k
            own = at < first[few + 1]
            short[own] = short[own] * np.uint64(0xD6E8FEB86659FD93) + hashes[at[own]]
        keys, row = np.concatenate([keys, K.mix(short + _STEP)]), np.concatenate([row, few])
    return keys, row


def bags(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, weight) of each distinct shingle of each row."""
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return keys[at], row[at], np.diff(np.append(at, len(keys)))


def signatures(keys: np.ndarray, row: np.ndarray, weight: np.ndarray, rows: int, size: int) -> np.ndarray:
    """The first point's time for each row and component (infinite for an empty bag)."""
    found = np.full(rows * size, np.inf)
    level = np.zeros(len(keys), np.int64)
    top = np.ceil(np.log2(weight)).astype(np.int64) if len(weight) else level  # the last range that reaches into the weight
    if len(top) and top.max() > 0:  # a process for each range below the weight
        again = np.repeat(np.arange(len(keys)), top + 1)
        level = np.arange(len(again)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
        keys, row, weight = keys[again], row[again], weight[again]
    seed = K.mix(keys + _STEP * (level + 1).astype(np.uint64))
    rate = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    low = np.where(level > 0, rate, 0.0)
    time, step = np.zeros(len(seed)), 0
    while len(seed):
        step += 1
        draw = K.mix(seed + _STEP * np.uint64(step))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        other = K.mix(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        cell = row * size + (other % np.uint64(size)).astype(np.int64)
        counts = low + rate * ((other >> np.uint64(32)).astype(np.float64) * 2.0**-32) < weight
        np.minimum.at(found, cell[counts], time[counts])
        last = found.reshape(rows, size).max(1)
        live = time < last[row]
        seed, row, weight, rate, low, time = seed[live], row[live], weight[live], rate[live], low[live], time[live]
    return found.reshape(rows, size)


def _sketches(found: np.ndarray) -> np.ndarray:
    """Four bits of each component, sixteen components to a number."""
    bits = np.zeros((len(found), -(-found.shape[1] // 16) * 16), np.uint64)
    bits[:, : found.shape[1]] = K.mix(found) & np.uint64(15)
    return (bits.reshape(len(found), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64)


def _disagreeing(a: str, b: str) -> Column:
    """Components in which two sketches differ."""

    def each(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x1111111111111111)))

    return F.aggregate(F.zip_with(a, b, each), F.lit(0), lambda n, x: n + x)


def _band_rows(docs: DataFrame, bands: int, per_band: int) -> DataFrame:
    """uid, h1, h2, n (shingles), bands, sketch."""

    bounded_batches(docs.sparkSession)
    def run(batches):
        for batch in K.slices(batches, "text", 1_000_000):
            keys, row = shingles(*K.buffer_of(batch.column("text")))
            n = np.bincount(row, minlength=batch.num_rows)
            whole = signatures(*bags(keys, row), batch.num_rows, bands * per_band).view(np.uint64)
            found, sketch = whole.reshape(batch.num_rows, bands, per_band), _sketches(whole).view(np.int64)
            key = np.zeros((batch.num_rows, bands), np.uint64) + np.arange(bands, dtype=np.uint64) * _STEP
            for k in range(per_band):
                key = K.mix(key + found[:, :, k])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) for x in (key.view(np.int64), sketch)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("uid", "h1", "h2")], pa.array(n.astype(np.int64)), *lists], names=["uid", "h1", "h2", "n", "bands", "sketch"])

    return docs.mapInArrow(run, "uid long, h1 long, h2 long, n long, bands array<long>, sketch array<long>")


def _bag_rows(docs: DataFrame) -> DataFrame:
    """doc, h, n, units: one 32-bit number for each shingle and each time it occurs, so that bags compare as sets."""

    def run(batches):
        for batch in K.slices(batches, "text", 1_000_000):
            key, row, weight = bags(*shingles(*K.buffer_of(batch.column("text"))))
            each = np.repeat(np.arange(len(key)), weight)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(weight) - weight, weight)
            units = (K.mix(key[each] + _STEP * nth.astype(np.uint64)) >> np.uint64(32)).astype(np.uint32)
            owner = row[each]
            order = np.lexsort((units, owner))
            units, owner = units[order], owner[order]
            once = np.flatnonzero(np.append(True, (units[1:] != units[:-1]) | (owner[1:] != owner[:-1]))) if len(units) else np.zeros(0, np.int64)
            units, owner = units[once].view(np.int32), owner[once]  # two shingles of one text with one number count once
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("h1"), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(first), pa.array(units))], names=["doc", "h", "n", "units"])

    return docs.mapInArrow(run, "doc long, h long, n long, units array<int>")


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b), nodes of one connected component having one root.

    Contraction: every node moves to the neighbour of least rank (or stays), and on from there up to four moves; edges
    between the images remain. Ranks are the ids in odd rounds, which folds stars, and random in even ones, which takes a
    constant share off chains.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    moved, step = None, 0
    while not edges.isEmpty():
        step += 1
        rank = lambda c: F.struct((F.col(c) if step % 2 else F.xxhash64(F.col(c), F.lit(step))).alias("r"), F.col(c).alias("to"))  # noqa: B023, E731
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.least(rank("a"), rank("b")).alias("best")), F.struct(F.col("b").alias("node"), F.least(rank("a"), rank("b")).alias("best")))).alias("e")).select("e.*")
        to = ends.groupBy("node").agg(F.min("best").alias("best")).select("node", F.col("best.to").alias("to"))
        for _ in range(2):  # moves lead to lower ranks only, so following them ends
            to = materialize(to, "moves")
            to = to.join(to.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to"))
        to = materialize(to, "moves")
        a = to.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        b = to.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        fewer = materialize(edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(edges)
        edges = fewer
        if moved is None:
            moved = materialize(to.select("node", F.col("to").alias("root")), "roots")
        else:
            on = to.select(F.col("node").alias("root"), "to")
            further = materialize(moved.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
            discard(moved)
            moved = further
        discard(to)
    return moved if moved is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _joined_classes(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root after more links: only the classes that these connect are worked on."""
    if roots is None:
        return materialize(components(links), "classes-so-far")
    for c in ("a", "b"):
        links = links.join(roots.withColumnsRenamed({"node": c, "root": f"r{c}"}), c, "left").withColumn(c, F.coalesce(f"r{c}", c)).drop(f"r{c}")
    moved = materialize(components(links), "classes-moved")
    on = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    old = roots.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return materialize(old.unionByName(moved.join(roots, "node", "left_anti")), "classes-so-far")


def _shares(c: Column, n: Column, hundredths: int) -> Column:
    """Whether c common units among n in all make a similarity of so many hundredths."""
    return 100 * c >= hundredths * (n - c)


def _measured(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """The pairs (doc, pivot) with h, n and c (units in common), and the units that only doc has, for each text of either."""
    spread = pairs.groupBy("pivot").agg(F.floor(F.count("*") / HOT).cast("int").alias("more")).where("more > 0")
    spread = broadcast_if_small(materialize(spread, "hot-pivots"))  # one of HOT pairs at most
    salted = pairs.join(spread, "pivot", "left").select("doc", "pivot", F.pmod(F.xxhash64("doc"), F.coalesce("more", F.lit(0)) + 1).alias("salt"))
    own = units.select("doc", "n", F.col("units").alias("du"))
    pivots = units.select(F.col("doc").alias("pivot"), F.col("h").alias("ph"), F.col("n").alias("pn"), F.col("units").alias("pu")).join(spread, "pivot", "left")
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("more", F.lit(0))))).drop("more")
    both = salted.join(own, "doc").join(pivots, ["pivot", "salt"])
    both = both.select("doc", "pivot", "ph", "n", "pn", F.array_except("du", "pu").alias("added"))
    return both.withColumn("c", F.col("n") - F.size("added"))


def _apart(members: DataFrame, nearness: DataFrame) -> DataFrame:
    """bucket, doc, label, far (from the bucket's pivot), c, only (null) of the members that aren't linked to the pivot.

    members: bucket, doc, label, pivot; nearness: doc, pivot, far, linked.
    """
    return members.join(nearness, ["doc", "pivot"]).where("not linked").select("bucket", "doc", "label", "far", *[F.lit(None).cast("long").alias(c) for c in ("c", "only")])


def _far_pairs(placed: DataFrame, sketches: DataFrame, similar: int, most: int) -> DataFrame:
    """doc, pivot: the far members with the others of their bucket that are of another class and may be similar."""
    placed = materialize(placed, "apart")
    some = placed.groupBy("bucket").agg(F.count("*").alias("all"), F.max("far").alias("any_far")).where("all > 1 and any_far").select("bucket", F.floor(F.col("all") / SMALL).cast("int").alias("more"))
    rows = materialize(placed.join(some, "bucket").join(sketches, "doc"), "compared")
    salts = F.explode(F.sequence(F.lit(0), F.col("more"))).alias("salt")
    other = rows.select("bucket", salts, *[F.col(c).alias(f"o_{c}") for c in ("doc", "label", "far", "n", "sketch", "c", "only")])
    fits = (F.col("label") != F.col("o_label")) & (100 * F.least("n", "o_n") >= similar * F.greatest("n", "o_n")) & (~F.col("o_far") | (F.col("doc") < F.col("o_doc")))
    # Of a common pivot's units they share c at most, of others no more than either has.
    reach = F.coalesce((100 + similar) * (F.least("c", "o_c") + F.least("only", "o_only")) >= similar * (F.col("n") + F.col("o_n")), F.lit(True))
    fits = fits & reach
    found = rows.where("far").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("more") + 1).cast("int")).join(other, ["bucket", "salt"]).where(fits & (_disagreeing("sketch", "o_sketch") <= most))
    out = materialize(found.select("doc", F.col("o_doc").alias("pivot")).distinct(), "far-pairs")
    discard(placed, rows)
    return out


def _by_unit(near: DataFrame) -> DataFrame:
    """bucket, doc, deg, label, c, only: a bucket for each unit that members of two classes have and their pivot has not.

    A pivot's members meet in one task (in one for each HOT_UNITS units, dealt by unit, if they have more), which counts
    the units, so that only those in question become rows.
    """
    more = near.groupBy("pivot", "ph").agg(F.floor(F.sum(F.size("added")) / HOT_UNITS).cast("int").alias("more")).where("more > 0")
    rows = near.select("pivot", "ph", "doc", "label", "c", "only", "added", F.lit(0).alias("slot"))
    more = materialize(more, "hot-units")
    if not more.isEmpty():
        slots = rows.drop("slot").join(broadcast_if_small(more), ["pivot", "ph"], "left").withColumn("more", F.coalesce("more", F.lit(0)) + 1)
        slots = slots.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("more") - 1)))
        rows = slots.withColumn("added", F.filter("added", lambda u: F.pmod(u, F.col("more")) == F.col("slot"))).drop("more").where(F.size("added") > 0)
    names = ["doc", "label", "c", "only"]

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        columns = {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in parts]) for n in ("pivot", "ph", *names)}
        units = np.concatenate([b.column("added").flatten().to_numpy(zero_copy_only=False) for b in parts])
        if not len(units):
            return
        owner = np.repeat(np.arange(len(columns["doc"])), np.concatenate([np.diff(b.column("added").offsets.to_numpy()) for b in parts]))
        of = K.mix(K.mix(columns["pivot"].view(np.uint64)) + columns["ph"].view(np.uint64))
        key = K.mix(of[owner] + _STEP * (units.view(np.uint32).astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key)
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        label = columns["label"][owner]
        mixed = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
        kept = np.repeat(mixed, np.diff(np.append(first, len(key))))
        key, owner = key[kept].view(np.int64), owner[kept]
        for k in range(0, len(key), 100_000):
            some = owner[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 100_000]), *[pa.array(columns[n][some]) for n in names]], names=["bucket", *names])

    return rows.repartition("pivot", "ph", "slot").drop("slot").mapInArrow(run, "bucket long, doc long, label long, c long, only long")


def _following(near: DataFrame, roots: DataFrame | None, similar: int) -> DataFrame:
    """bucket, doc, label, c, only (units that the pivot has not): where members can still be linked to each other, given what they share with their pivot.

    near: doc, pivot, ph, n, pn, c, added of the members that aren't far from the pivot.
    """
    if roots is not None:
        near = near.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("root", "doc")).drop("root")
    else:
        near = near.withColumn("label", F.col("doc"))
    mixed = near.groupBy("pivot", "ph").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("pivot", "ph")
    near = near.join(broadcast_if_small(materialize(mixed, "open-pivots")), ["pivot", "ph"])
    near = near.withColumns({"linked": _shares(F.col("c"), F.col("n") + F.col("pn"), similar), "reach": F.col("c") * (100 + similar) / similar - F.col("n"), "bin": F.floor(1024 * F.col("c") / F.col("pn")), "only": F.col("n") - F.col("c")})
    near = materialize(near, "open")
    by_unit = _by_unit(near)
    # Without such a unit: the member with fewer units of the pivot reaches the other's size.
    of = lambda c, linked: F.when(F.col("linked") == linked, F.col(c))
    bins = near.groupBy("pivot", "ph", "bin").agg(*[agg(of(c, linked)).alias(f"{c}_{linked}".lower()) for c, agg in (("reach", F.max), ("n", F.min)) for linked in (True, False)])
    below, above = [Window.partitionBy("pivot", "ph").orderBy("bin").rowsBetween(*r) for r in ((Window.unboundedPreceding, 0), (0, Window.unboundedFollowing))]
    bins = bins.select("pivot", "ph", "bin", *[agg(c).over(w).alias(f"best_{c}") for c, agg, w in (("reach_true", F.max, below), ("reach_false", F.max, below), ("n_true", F.min, above), ("n_false", F.min, above))])
    met = near.join(bins, ["pivot", "ph", "bin"])
    with_unlinked = (F.col("reach") >= F.col("best_n_false")) | (F.col("n") <= F.col("best_reach_false"))
    with_linked = (F.col("reach") >= F.col("best_n_true")) | (F.col("n") <= F.col("best_reach_true"))
    met = met.where(F.coalesce(with_unlinked, F.lit(False)) | (~F.col("linked") & F.coalesce(with_linked, F.lit(False))))
    every = materialize(by_unit.unionByName(met.select(F.xxhash64(F.lit(2), "pivot", "ph").alias("bucket"), "doc", "label", "c", "only")), "following")
    mixed = every.groupBy("bucket").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("size"), *[F.bit_xor(F.xxhash64("doc", F.lit(k))).alias(f"x{k}") for k in (1, 2)]).where("a <> b")
    mixed = mixed.groupBy("size", "x1", "x2").agg(F.min("bucket").alias("bucket")).select("bucket")  # one of those with the same members
    out = materialize(every.join(broadcast_if_small(materialize(mixed, "mixed")), "bucket"), "members")
    discard(near, every)
    return out


def _uid(id_col: str, text_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), -1 - F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 1))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (the least id of its class), kept (it is that document).

    A class holds all documents that links of ``similar`` hundredths or more connect. Texts without words form a class
    with equal texts only; a null text is alone. A null id takes part under a negative number made of its text; rows of
    one id are in one class. Other columns are ignored; an empty table gives no rows. ``options`` as in :func:`_classified`.
    """
    return _classified(docs, **options).drop("uid")


def _classified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similar: int = SIMILAR, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """:func:`near_duplicates` with uid, the id that a row takes part under."""
    text = F.col(text_col)
    named = docs.select(F.col(id_col).alias("doc_id"), _uid(id_col, text_col).alias("uid"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), text.alias("text"))
    filled = named.where("text is not null")
    texts = materialize(filled.groupBy("h1", "h2").agg(F.min("uid").alias("rep"), F.count("*").alias("copies")), "texts")
    # Only texts with copies are looked up: most have none, and theirs need not be shuffled.
    copied = broadcast_if_small(materialize(texts.where("copies > 1").select("h1", "h2", "rep"), "copied"))
    first = filled.join(copied, ["h1", "h2"], "left").where("rep is null or rep = uid").select("uid", "h1", "h2", "text")
    sigs = materialize(_band_rows(first, bands, rows), "bands")
    repeated = sigs.count() > texts.count()  # rows that are equal to their text's first in id and text
    if repeated:
        sigs = materialize(sigs.dropDuplicates(["h1", "h2"]), "bands-once")
    members = sigs.where("n > 0").select(F.col("uid").alias("doc"), F.explode("bands").alias("bucket")).distinct() if repeated else sigs.where("n > 0").select(F.col("uid").alias("doc"), F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(members.join(shared, "bucket"), "shared")
    degrees = materialize(members.groupBy("doc").agg(F.sum("size").alias("deg")), "degrees")
    wanted = broadcast_if_small(degrees.select(F.col("doc").alias("uid")))
    units = _bag_rows(first.join(wanted, "uid", "left_semi"))
    units = materialize(units.dropDuplicates(["doc", "h"]) if repeated else units, "bags")
    sketches = sigs.select(F.col("uid").alias("doc"), "n", "sketch")
    members = materialize(members.select("bucket", "doc").join(degrees, "doc").withColumn("label", F.col("doc")), "members")
    p, size = similar / 100 + (1 - similar / 100) / 16, bands * rows  # a component's four bits agree with probability p
    most = int(size * (1 - p) + 5 * (size * p * (1 - p)) ** 0.5) + 1
    apart = max(0, 2 * similar - 100)
    roots = None

    def joined(links: DataFrame) -> None:
        nonlocal roots
        links = materialize(links.select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct(), "links")
        if not links.isEmpty():
            fresh = _joined_classes(roots, links)
            discard(*([roots] if roots is not None else []))
            roots = fresh
        discard(links)

    if not members.isEmpty():
        best = members.groupBy("bucket").agg(F.min(F.struct(-F.col("deg"), "doc")).alias("p")).select("bucket", F.col("p.doc").alias("pivot"))
        placed = materialize(members.join(broadcast_if_small(materialize(best, "pivots")), "bucket").where("doc <> pivot"), "placed")
        near = materialize(_measured(placed.select("doc", "pivot").distinct(), units), "near")
        total = F.col("n") + F.col("pn")
        linked, close = _shares(F.col("c"), total, similar), _shares(F.col("c"), total, apart)
        nearness = near.groupBy("doc", "pivot").agg(F.min(~close).alias("far"), F.max(linked).alias("linked"))
        far = _far_pairs(_apart(placed, nearness), sketches, similar, most)
        joined(near.where(linked).select("doc", "pivot").unionByName(_measured(far, units).where(linked).select("doc", "pivot")))
        following = _following(near.where(close), roots, similar)
        discard(members, placed, near, far)
        if not following.isEmpty():
            far = _far_pairs(following.withColumn("far", F.lit(True)), sketches, similar, most)
            joined(_measured(far, units).where(linked).select("doc", "pivot"))
            discard(far)
        discard(following)
    least = texts.withColumn("class", F.col("rep"))
    if roots is not None:
        named_roots = roots.join(roots.groupBy("root").agg(F.min("node").alias("class")), "root").select(F.col("node").alias("rep"), "class")
        least = texts.join(named_roots, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    least = materialize(least.select("h1", "h2", "copies", "class"), "classes")
    named = named.select("doc_id", "uid", "h1", "h2", F.col("text").isNotNull().alias("filled"))
    # Texts with very many copies are broadcast (one for HOT rows at most), so that none makes a task large.
    often = least.where(F.col("copies") > HOT).select("h1", "h2", F.col("class").alias("often"))
    out = named.where("filled").join(broadcast_if_small(materialize(often, "often")), ["h1", "h2"], "left")
    seldom = least.where(F.col("copies") <= HOT).select("h1", "h2", "class")
    rest = out.where("often is null").drop("often").join(broadcast_if_small(seldom), ["h1", "h2"])
    out = rest.unionByName(out.where("often is not null").withColumnRenamed("often", "class"))
    out = out.select("doc_id", F.col("class").alias("class_id"), (F.col("uid") == F.col("class")).alias("kept"), "uid")
    return out.unionByName(named.where("not filled").select("doc_id", F.col("uid").alias("class_id"), F.lit(True).alias("kept"), "uid"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, with all its columns; of repeated rows of the kept document, one stays.

    Null texts stay, each under its id; columns of any name pass through as they are; an empty table gives no rows.
    """
    found = materialize(_classified(docs, id_col=id_col, text_col=text_col, **options).select("uid", "kept"), "kept")
    kept = found.where("kept").select("uid")
    gone = materialize(found.where("not kept").select("uid").distinct().join(kept, "uid", "left_anti"), "gone")
    uid = unused(docs, "uid")
    rows = docs.withColumn(uid, _uid(id_col, text_col))
    rows = rows.join(broadcast_if_small(gone.withColumnRenamed("uid", uid)), uid, "left_anti")  # those that go are fewer than those that stay
    if kept.count() > kept.distinct().count():
        rows = rows.dropDuplicates([uid])
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])
