"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents are tokenized once, on the executors; what goes on is a row per piece. Pieces and gaps are matched in bulk
rounds, longest pieces first: the pieces of one length, ordered by rank, meet the smallest gaps that hold them (a sweep
to the successor in the order of gaps), equal gaps are taken by rank, and what is left of them re-enters the order. As
lengths are whole numbers up to the capacity, pieces and gaps of one length are interchangeable and the rounds can run
on counts: pieces by length, runs of equal gaps. The plan is of a size that the capacity bounds, not the data; the
executors rank the pieces of each length (salted, so a common length is spread) and look their places up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernels as K
from .common import bounded_batches, materialize

CAPACITY = 4096
EOS = 1
#: Pieces of one length that one window partition ranks, about.
RANK_ROWS = 1_000
_ENCODERS: dict = {}


def _encoder(path: str):
    from .bpe import WordEncoder

    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenized_pieces(docs: DataFrame, *, id_col: str, text_col: str, capacity: int, path: str, eos: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and ``eos``, cut after every ``capacity`` ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    bounded_batches(docs.sparkSession)
    def run(batches):
        encoder = _encoder(path)
        for batch in K.slices(batches, "text", 2_000_000):
            found, n = encoder.encode(batch.column("text"))
            n += 1  # the end id
            first = np.append(0, np.cumsum(n))
            ids = np.full(first[-1], eos, "<u4")
            inner = np.ones(len(ids), bool)
            inner[first[1:] - 1] = False
            ids[inner] = found
            cuts = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), cuts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            at, whole = first[row] + start, memoryview(ids).cast("B")
            crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, sequence of it, offset there, pieces per sequence), by length and rank.

    counts: pieces by length. The rank-th piece of a length, idx behind its row's first rank, goes to sequence
    ``sequence + idx // each`` at ``offset + idx % each * length``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # runs (first sequence, how many) by what is left in each
    order: list[int] = []  # the gaps in use, sorted
    opened, out = 0, []

    def put(gap: int, first: int, n: int) -> None:
        if gap > 0 and n > 0:
            if gap not in gaps:
                insort(order, gap)
            gaps.setdefault(gap, []).append((first, n))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            k = bisect_left(order, size)
            if k == len(order):
                each = capacity // size
                put(capacity, opened, need := -(-left // each))
                opened += need
                continue
            gap = order[k]
            each = gap // size
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            full = min(n, left // each)
            if full:
                out.append((size, rank, first, capacity - gap, each))
                rank, left = rank + full * each, left - full * each
                put(gap - each * size, first, full)
            if full < n and left and left < each:  # the last gap takes fewer
                out.append((size, rank, first + full, capacity - gap, left))
                put(gap - left * size, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(gap, first + full, n - full)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def _placed(ranked: DataFrame, table: np.ndarray) -> DataFrame:
    keys = (table[:, 0] << 40) + table[:, 1]

    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            own = table[np.searchsorted(keys, (length << 40) + rank, "right") - 1]
            idx = rank - own[:, 1]
            sequence, offset = own[:, 2] + idx // np.maximum(own[:, 4], 1), own[:, 3] + idx % np.maximum(own[:, 4], 1) * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, eos: int = EOS) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row for each piece.

    A null text counts as empty and is one piece of the end id alone. Ids may be null or repeat, and so may rows: each
    is packed. Other columns are ignored; an empty table gives no rows. ``tokenizer`` is the vocabulary file's path.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = materialize(tokenized_pieces(docs, id_col=id_col, text_col=text_col, capacity=capacity, path=path, eos=eos), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one for each length up to the capacity
    salts = F.array(*[F.lit(1 + counts.get(n, 0) // RANK_ROWS) for n in range(1, capacity + 1)])
    dealt = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(salts, F.col("length").cast("int"))))
    sizes = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("k") - 1)
    return _placed(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), plan(counts, capacity))
