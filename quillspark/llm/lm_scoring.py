"""Language-model scores: a unigram base, and a probabilistic suffix tree over the bytes of texts.

The tree's symbols are the bytes of a text's words, each word ended by a blank and the text by a line feed; contexts
are the ``DEPTH`` symbols before, whatever word they belong to (blanks before a text's first). From all training
documents every window of a symbol and its context is counted; shorter contexts follow by summing. A context is a
candidate if at least ``LEAST_COUNT`` symbols follow it, so the tree grows with the corpus; it is retained if the
likelihood ratio of its next-symbol distribution against that of its longest retained suffix outweighs the parameters
it adds. Distributions are smoothed by that suffix's (Witten-Bell); a symbol is scored by the longest retained suffix
of what precedes it. The tree is made level by level by joins. Up to ``TREE_ROWS``
retained counts go to the executors as a whole; a larger tree goes there in parts, by spans of contexts, ``AT_ONCE``
together, and the texts are read again for the next. The score of a text is the sum over its symbols, its end included.

Counts of all tokens are needed for the base alone. Tokens that make up at least ``1 / FREQUENT`` of the
training tokens (so at most ``FREQUENT`` of them) are looked up on the executors; the others are joined by a shuffle.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernels as K
from .common import bounded_batches, discard, materialize

#: A window of a symbol and its context is one 64-bit number.
DEPTH = 7
LEAST_COUNT = 64
#: Retained counts (context and symbol) of a tree that is held in memory.
TREE_ROWS = 4_000_000
#: Retained counts of each part of a larger one, about, as the driver makes them; and parts that go out together.
PART_ROWS, AT_ONCE = 2_000_000, 3
FREQUENT = 1 << 20
END, BLANK = 10, 32
#: The end of a text as a token, beside the words' hashes.
END_KEY = np.uint64(1)
#: Counts that a task holds before it sends them on.
HELD = 6_000_000
#: Counts go to reducers by buckets of the hashes of words, or of this many context symbols: longer contexts that share
#: them meet in one bucket.
BUCKETS = 1 << 12
NEAR = 4
#: Contexts of more symbols than this count as deep.
SHORT = 5


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(DEPTH + 2)], np.uint64).view(np.int64)
_FILL = np.array([sum(BLANK << 8 * i for i in range(k, DEPTH + 1)) for k in range(DEPTH + 2)], np.int64)


def symbols(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, begins, token keys, row): every symbol with the DEPTH before it as one number; where each token begins
    among them; tokens in order, the rows' ends with their words (all as ends if not ``hashed``)."""
    data = K.LOWER[data]
    starts, ends, first = K.word_bounds(data, offsets)
    rows, words = len(offsets) - 1, len(starts)
    word_at = np.arange(words) + np.repeat(np.arange(rows), np.diff(first))  # each row's end comes after its words
    end_at = first[1:] + np.arange(rows)
    sizes = np.ones(words + rows, np.int64)
    sizes[word_at] = ends - starts + 1
    begins = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    padded = np.full(DEPTH + total, BLANK, np.uint8)
    out = padded[DEPTH:]
    out[begins[end_at]] = END
    if words:
        lengths = ends - starts
        out[np.repeat(begins[word_at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = data[~K.SPACE[data]]
    windows = np.ndarray(total, ">i8", padded, 0, (1,)).astype(np.int64)  # from each byte on, the last one lowest
    texts = np.append(0, begins[end_at][:-1] + 1)
    for inside in range(1, DEPTH + 1):  # so many symbols of the text so far
        at = texts[begins[end_at] - texts >= inside - 1] + inside - 1
        windows[at] = windows[at] & _KEEP[inside] | _FILL[inside]
    keys = np.full(words + rows, END_KEY, np.uint64)
    if hashed:
        keys[word_at] = K.word_hashes(data, starts, ends)
    row = np.empty(words + rows, np.int64)
    row[word_at], row[end_at] = np.repeat(np.arange(rows), np.diff(first)), np.arange(rows)
    return windows, begins, keys.view(np.int64), row


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    at = _runs(keys)
    return keys[at], np.add.reduceat(n, at) if len(at) else n


def _counted(docs: DataFrame) -> DataFrame:
    """bucket (those of words after those of windows), keys, n (64-bit numbers): counts over the rows, added up per
    task as far as memory allows. All windows whose contexts end in the same NEAR symbols are in one bucket."""

    def sent(kind, keys, n):
        bucket = (K.mix(keys >> 8 & _KEEP[NEAR] if kind else keys) & np.uint64(BUCKETS - 1)).astype(np.int16)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, n = bucket[order], keys[order], n[order]
        at = np.append(_runs(bucket), len(bucket))
        for k in range(0, len(at) - 1, 256):
            cuts = at[k : k + 257]
            low, high = cuts[0], cuts[-1]
            offsets = pa.py_buffer((8 * (cuts - low)).astype(np.int32))
            lists = [pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(x[low:high])]) for x in (keys, n)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32) + (0 if kind else BUCKETS)), *lists], names=["bucket", "keys", "n"])

    def run(batches):
        held: list[list] = [[], []]
        for batch in K.slices(batches, "text"):
            windows, _, words, _ = symbols(*K.buffer_of(batch.column("text")))
            for kind, keys in enumerate((words, windows)):
                keys, n = np.unique(keys, return_counts=True)
                held[kind].append((keys, n.astype(np.int64)))
                if sum(len(k) for k, _ in held[kind]) > HELD:
                    held[kind] = [_merged(held[kind])]
                    if len(held[kind][0][0]) > HELD // 2:
                        yield from sent(kind, *held[kind][0])
                        held[kind] = []
        for kind in (0, 1):
            if held[kind]:
                yield from sent(kind, *_merged(held[kind]))

    return docs.mapInArrow(run, "bucket int, keys binary, n binary")


def _summed(counted: DataFrame) -> DataFrame:
    """kind (0 words, else 1 + the depth of a context), key, n from whole buckets: all words, all windows of NEAR
    context symbols, and those of more whose context LEAST_COUNT symbols follow."""

    def rows(kind, keys, n):
        for k in range(0, len(keys), 100_000):
            part = keys[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(n[k : k + 100_000])], names=["kind", "key", "n"])

    def levels(keys, n):
        for d in range(DEPTH, NEAR - 1, -1):
            if d < DEPTH:
                keys, n = _merged([(keys & _KEEP[d + 1], n)])
            order = np.argsort(context := keys >> 8 & _KEEP[d])
            new = _runs(context[order])
            follow = np.add.reduceat(n[order], new)
            often = np.repeat(follow >= (LEAST_COUNT if d > NEAR else 0), np.diff(np.append(new, len(keys))))
            yield from rows(1 + d, keys[order][often], n[order][often])

    def run(batches):
        held, last, most = [], -1, HELD

        def done():
            if held:
                found = _merged(held)
                yield from levels(*found) if last < BUCKETS else rows(0, *found)

        for batch in batches:
            for bucket, *pair in zip(batch.column("bucket").to_pylist(), batch.column("keys"), batch.column("n"), strict=True):
                size = sum(len(k) for k, _ in held)
                if bucket != last and (size > HELD // 4 or (bucket < BUCKETS) != (last < BUCKETS)):
                    yield from done()
                    held, size, most = [], 0, HELD
                last = bucket
                held.append(tuple(np.frombuffer(x.as_buffer(), np.int64) for x in pair))
                if size + len(held[-1][0]) > most:
                    held = [_merged(held)]
                    most = max(HELD, 2 * len(held[0][0]))
        yield from done()

    return counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "kind int, key long, n long")


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _each_distinct(keys: np.ndarray, found) -> np.ndarray:
    """What ``found`` gives for the distinct keys, in order, for every key."""
    order = np.argsort(keys)
    own = keys[order]
    new = _runs(own)
    values = found(own[new])
    out = np.empty(len(keys), values.dtype)
    out[order] = np.repeat(values, np.diff(np.append(new, len(keys))))
    return out


class SuffixTree:
    """Retained contexts and their smoothed distributions; log probabilities to base 10."""

    def __init__(self, root: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """root: counts of the 256 symbols; levels: for depth 1 and on, (context, symbol, count) of the candidates."""
        total = max(1, int(root.sum()))
        p = (root + 1 / 256) / (root.sum() + 1.0)
        self.codes = np.zeros(1, np.int64)  # depth << 8 * DEPTH | context, sorted
        self.parent, self.backoff = np.zeros(1, np.int64), np.zeros(1)
        self.entries, self.values = np.arange(256, dtype=np.int64), np.log10(p)
        for depth, (context, symbol, count) in enumerate(levels, 1):
            if not len(context):
                continue
            own, at = np.unique(context, return_inverse=True)
            n = np.bincount(at, count)
            kinds = np.bincount(at)
            mean = 10.0 ** self.look_up(self.longest(context, depth - 1), symbol)
            share = count / n[at]
            gain = np.bincount(at, count * np.log(share / mean))
            kept = gain > 0.5 * kinds * np.log(total)
            if not kept.any():
                continue
            number = np.full(len(own), -1, np.int64)
            number[kept] = len(self.codes) + np.arange(int(kept.sum()))
            use = kept[at]
            smooth = (count + kinds[at] * mean) / (n + kinds)[at]
            self.parent = np.append(self.parent, self.longest(own[kept], depth - 1))
            self.backoff = np.append(self.backoff, np.log10(kinds[kept] / (n + kinds)[kept]))
            self.codes = np.append(self.codes, depth << 8 * DEPTH | own[kept])
            entries, values = np.append(self.entries, number[at[use]] << 8 | symbol[use]), np.append(self.values, np.log10(smooth[use]))
            order = np.argsort(entries)
            self.entries, self.values = entries[order], values[order]
        # Codes grow with depth and with the context within one, so they are sorted as they are.

    def longest(self, context: np.ndarray, depth: int) -> np.ndarray:
        """The longest retained suffix, of ``depth`` symbols at most, of each context."""
        out = np.zeros(len(context), np.int64)
        open_ = np.arange(len(context))
        for d in range(depth, 0, -1):
            code = d << 8 * DEPTH | (context[open_] & ((1 << 8 * d) - 1))
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code
            out[open_[hit]] = at[hit]
            open_ = open_[~hit]
        return out

    def look_up(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out, state, todo = np.zeros(len(state)), state.copy(), np.arange(len(state))
        while len(todo):
            key = state[todo] << 8 | symbol[todo]
            at = np.minimum(np.searchsorted(self.entries, key), len(self.entries) - 1)
            hit = self.entries[at] == key
            out[todo[hit]] += self.values[at[hit]]
            todo = todo[~hit]
            out[todo] += self.backoff[state[todo]]
            state[todo] = self.parent[state[todo]]
        return out

    def window_scores(self, keys: np.ndarray) -> np.ndarray:
        return self.look_up(self.longest(keys >> 8 & _KEEP[DEPTH], DEPTH), keys & 255)


class Memo:
    """Windows' scores by a tree, from sorted pieces that are made once.

    With a window's bytes turned round (the symbol first, then its context from the nearest on), the windows of a
    retained context and symbol are one span of numbers, and so are the contexts with a retained suffix. Spans nest or
    are apart, so their bounds part all windows into pieces: one search finds the deepest entry, another the longest
    retained suffix. Sums go the way of :meth:`SuffixTree.look_up`, so scores are the same to the last bit. Windows
    whose context, turned round, is not from ``low`` to below ``high`` count 0: the tree may lack what is not there.
    """

    def __init__(self, tree: SuffixTree, low: int = 0, high: int = 1 << 8 * DEPTH):
        self.low, self.high = np.uint64(low), np.uint64(high)
        turned = lambda context: context.astype(np.uint64).byteswap() >> np.uint64(8)
        depth, context = (tree.codes >> 8 * DEPTH).astype(np.int8), turned(tree.codes & _KEEP[DEPTH])
        self.parent, self.backoff = tree.parent.astype(np.int32), tree.backoff
        self.contexts, self.longest = _pieces(context, depth)
        state = (tree.entries >> 8).astype(np.int32)
        start = tree.entries.astype(np.uint64)
        start <<= np.uint64(8 * DEPTH)
        start |= context[state]
        self.windows, entry = _pieces(start, depth[state])
        self.values, self.owners = tree.values[entry], state[entry]

    def __call__(self, windows: np.ndarray) -> np.ndarray:
        keys = windows.view(np.uint64).byteswap()
        context = keys & _KEEP.view(np.uint64)[DEPTH]
        inside = (context >= self.low) & (context < self.high)
        if inside.all():
            return _each_distinct(keys, self._scores)
        out = np.zeros(len(keys))
        out[inside] = _each_distinct(keys[inside], self._scores)
        return out

    def _scores(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.windows, keys, "right") - 1
        out, owner = self.values[at], self.owners[at]
        state = self.longest[np.searchsorted(self.contexts, keys & _KEEP.view(np.uint64)[DEPTH], "right") - 1]
        more = np.flatnonzero(state != owner)  # the longest suffix never saw the symbol
        state, owner, added, todo = state[more], owner[more], np.zeros(len(more)), np.arange(len(more))
        while len(todo):
            added[todo] += self.backoff[state[todo]]
            state[todo] = self.parent[state[todo]]
            todo = todo[state[todo] != owner[todo]]
        out[more] += added
        return out


def _pieces(start: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, which): where pieces begin, and the deepest of the spans that hold a piece. A span is all numbers from
    its start that differ in the DEPTH - depth bytes after its depth; the least deep ones leave no gap."""
    widths = np.uint64(1) << (8 * (DEPTH - np.arange(DEPTH + 1))).astype(np.uint64)
    bounds = np.concatenate([start, start + widths[depth]])
    bounds.sort()
    bounds = bounds[np.append(True, bounds[1:] != bounds[:-1])]
    which = np.zeros(len(bounds), np.int32)
    for d, width in enumerate(widths):
        own = np.flatnonzero(depth == d).astype(np.int32)
        own = own[np.argsort(start[own])]
        for k in range(0, len(own), 1 << 14):  # the memory of the driver is small
            some = own[k : k + (1 << 14)]
            low, high = np.searchsorted(bounds, start[some]), np.searchsorted(bounds, start[some] + (width - np.uint64(1)), "right")
            wide = high - low > 256
            for at, to, x in zip(low[wide], high[wide], some[wide], strict=True):
                which[at:to] = x
            low, n, some = low[~wide], (high - low)[~wide], some[~wide]
            which[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] = np.repeat(some, n)
    new = np.append(True, which[1:] != which[:-1])
    return bounds[new], which[new]


def _suffix(c: Column | str, depth: int) -> Column:
    return (F.col(c) if isinstance(c, str) else c).bitwiseAND(F.lit((1 << 8 * depth) - 1))


def count_all(docs: DataFrame) -> DataFrame:
    """kind (0 words, else 1 + the depth of a context), key, n, written down by kind: see :func:`_summed`."""
    return materialize(_summed(_counted(docs)), "counts", "kind")


def candidates(counted: DataFrame) -> list[DataFrame]:
    """By depth, from 0: context, symbol, n of the contexts that LEAST_COUNT symbols follow (all at depth 0)."""
    level = lambda d: counted.where(F.col("kind") == 1 + d).select(_suffix(F.shiftright("key", 8), d).alias("context"), F.col("key").bitwiseAND(255).alias("symbol"), "n")
    out, whole = [level(d) for d in range(DEPTH, NEAR, -1)], level(NEAR)
    for d in range(NEAR, -1, -1):
        if d < NEAR:
            whole = whole.withColumn("context", _suffix("context", d))
        each = whole.repartition("context").groupBy("context", "symbol").agg(F.sum("n").alias("n"))
        whole = materialize(each.withColumn("all", F.sum("n").over(Window.partitionBy("context"))), f"candidates-{d}")
        out.append(whole.where(F.col("all") >= (LEAST_COUNT if d else 0)).drop("all"))
    return out[::-1]


def fit(levels: list[DataFrame]) -> tuple[np.ndarray, list[DataFrame]]:
    """The root's counts and, by depth from 1, the retained contexts: context, symbol, n, backoff, mean (p, smoothed).

    A candidate's suffixes are candidates, with all its symbols, so each level needs the one below only.
    """
    spark = levels[0].sparkSession
    root = levels[0].toArrow()
    counts = np.bincount(root["symbol"].to_numpy(), root["n"].to_numpy(), 256)
    known = spark.createDataFrame([(0, s, float(p)) for s, p in enumerate((counts + 1 / 256) / (counts.sum() + 1.0))], "suffix long, symbol long, mean double")
    total, out = max(1, int(counts.sum())), []
    w = Window.partitionBy("context")
    for d, level in enumerate(levels[1:], 1):
        joined = level.withColumn("suffix", _suffix("context", d - 1)).join(known if d > 1 else F.broadcast(known), ["suffix", "symbol"])
        each = joined.withColumns({"all": F.sum("n").over(w), "kinds": F.count("*").over(w)})
        each = each.withColumn("gain", F.sum(F.col("n") * F.log(F.col("n") / F.col("all") / F.col("mean"))).over(w))
        each = each.withColumn("kept", F.col("gain") > 0.5 * F.col("kinds") * float(np.log(total)))
        smooth = (F.col("n") + F.col("kinds") * F.col("mean")) / (F.col("all") + F.col("kinds"))
        each = materialize(each.select("context", "symbol", "n", "kept", F.log10(F.col("kinds") / (F.col("all") + F.col("kinds"))).alias("backoff"), F.when(F.col("kept"), smooth).otherwise(F.col("mean")).alias("mean")), f"tree-{d}")
        known = each.select(F.col("context").alias("suffix"), "symbol", "mean")
        out.append(materialize(each.where("kept").drop("kept"), f"kept-{d}"))
        if d > 1:
            discard(before)
        before = each
    if len(levels) > 1:
        discard(before)
    return counts, out


def in_memory(counts: np.ndarray, kept: list[DataFrame]) -> SuffixTree:
    found = []
    for level in kept:
        t = level.select("context", "symbol", "n").toArrow()
        context, symbol, n = (t[c].to_numpy() for c in ("context", "symbol", "n"))
        order = np.lexsort((symbol, context))
        found.append((context[order], symbol[order], n[order]))
    return SuffixTree(counts, found)


def parts(kept: list[DataFrame]) -> list[tuple[int, int, list[DataFrame]]]:
    """(low, high, levels): a tree in parts of about PART_ROWS counts, by spans of contexts that are turned round; with
    each, all retained contexts of which any lies there, so every context comes with its suffixes."""

    def start(d):
        byte = lambda i: F.shiftleft(F.shiftright("context", 8 * i).bitwiseAND(255), 8 * (DEPTH - 1 - i))
        return reduce(Column.bitwiseOR, map(byte, range(d)))

    starts = reduce(DataFrame.unionAll, [level.select(start(d).alias("start")) for d, level in enumerate(kept, 1)])
    n = max(2, -(-starts.count() // PART_ROWS))
    cuts = starts.agg(F.percentile_approx("start", [k / n for k in range(1, n)], 100_000)).first()[0]
    cuts = sorted({0, 1 << 8 * DEPTH, *(cuts or [])})
    return [
        (low, high, [level.where((start(d) < high) & (start(d) >= low - low % (1 << 8 * (DEPTH - d)))) for d, level in enumerate(kept, 1)])
        for low, high in zip(cuts, cuts[1:])
    ]


def _score(batch, value_of, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Per row: what the tree says, what the frequent tokens give to the base, and the other tokens' hashes for the join."""
    logs = np.log10(counts + 0.5)
    windows, begins, words, row = symbols(*K.buffer_of(batch.column("text")))
    by_token, rows = np.add.reduceat(value_of(windows), begins), batch.num_rows
    at = _each_distinct(words, lambda own: np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1)))
    hit = keys[at] == words if len(keys) else np.zeros(len(words), bool)
    base = np.bincount(row[hit], logs[at[hit]], rows)
    known = np.bincount(row[hit], minlength=rows)
    rest, owner = words[~hit], row[~hit]
    order = np.lexsort((rest, owner))
    rest, owner = rest[order], owner[order]
    new = np.flatnonzero(np.append(True, (rest[1:] != rest[:-1]) | (owner[1:] != owner[:-1]))) if len(rest) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(rest))).astype(np.int32)
    lists = pa.array(np.searchsorted(owner[new], np.arange(rows + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            *[batch.column(c) for c in ("rid", "doc_id", "held_out")], pa.array(np.bincount(row, minlength=rows).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(np.bincount(row, by_token, rows)),
            *[pa.ListArray.from_arrays(lists, pa.array(x)) for x in (rest[new], times)],
        ],
        names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rest", "times"],
    )


def _scored(rows: DataFrame, trees: list[Broadcast], keys: np.ndarray, counts: np.ndarray, schema: str) -> DataFrame:
    """The rows' scores by a tree, or its first parts, that every executor holds."""
    shared = rows.sparkSession.sparkContext.broadcast((keys, counts))

    def run(batches):
        for batch in K.slices(batches, "text", 2_000_000):
            yield _score(batch, lambda windows: sum(tree.value(windows) for tree in trees), *shared.value)

    out = materialize(rows.mapInArrow(run, schema), "scored")  # fixes rid
    shared.destroy()
    return out


def _more_scores(rows: DataFrame, trees: list[Broadcast]) -> DataFrame:
    """rid, more_score: what other parts of the tree say."""

    def run(batches):
        for batch in K.slices(batches, "text", 2_000_000):
            windows, begins, _, row = symbols(*K.buffer_of(batch.column("text")), False)
            sums = np.add.reduceat(sum(tree.value(windows) for tree in trees), begins[_runs(row)])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(sums)], names=["rid", "more_score"])

    return materialize(rows.select("rid", "text").mapInArrow(run, "rid long, more_score double"), "more")


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (the tree's) for every document.

    Training are the documents whose crc32 of the id as text, modulo ``folds``, isn't ``fold``. A null text counts as
    empty (its end is its only token), a null id as an empty one. Ids and rows may repeat: each counts. Other columns
    are ignored; an empty table gives no rows, and without training documents all symbols are equally likely.
    """
    bounded_batches(docs.sparkSession)
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held.alias("held_out"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counted = count_all(rows.where(~F.col("held_out")).select("text"))
    words = materialize(counted.where("kind = 0").select("key", "n"), "words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    levels = candidates(counted)
    frequent = words.where(F.col("n") * FREQUENT >= total).toArrow()
    order = np.argsort(keys := frequent["key"].to_numpy())
    schema = f"rid long, doc_id {id_type}, held_out boolean, n_tokens long, known long, base double, score double, rest array<long>, times array<int>"
    rows = rows.withColumn("rid", F.monotonically_increasing_id())
    lookup = (keys[order], frequent["n"].to_numpy()[order])
    tree = fit(levels)
    small = sum(level.count() for level in tree[1]) <= TREE_ROWS
    spans, others = [(0, 1 << 8 * DEPTH, tree[1])] if small else parts(tree[1]), []
    if again := len(spans) > AT_ONCE:
        rows = materialize(rows, "texts")  # fixes rid
    for k in range(0, len(spans), AT_ONCE):
        trees = [docs.sparkSession.sparkContext.broadcast(Memo(in_memory(tree[0], levels), low, high)) for low, high, levels in spans[k : k + AT_ONCE]]
        if k:
            others.append(_more_scores(rows, trees))
        else:
            scored = _scored(rows, trees, *lookup, schema)
        for x in trees:
            x.destroy()
    if again:
        discard(rows)
    rest = scored.select("rid", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("rid", F.col("w.rest").alias("key"), F.col("w.times").alias("times"))
    seldom = words.where(F.col("n") * FREQUENT < total)
    found = rest.join(seldom.hint("merge"), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    found = found.select("rid", (F.col("times") * F.log10(F.col("n") + 0.5)).alias("base"), F.when(F.col("n") > 0, F.col("times")).otherwise(0).alias("known"))
    found = found.groupBy("rid").agg(F.sum("base").alias("more_base"), F.sum("known").alias("more_known"))
    norm = float(np.log10(total + 0.5 * (distinct + 1)))
    more = lambda c, zero: F.col(c) + F.coalesce(f"more_{c}", F.lit(zero))
    out = scored.drop("rest", "times").join(found, "rid", "left")
    if others:
        others = reduce(DataFrame.unionAll, others).groupBy("rid").agg(F.sum("more_score").alias("more_score"))
        out = out.join(others, "rid").withColumn("score", more("score", 0.0))
    return out.select("doc_id", "held_out", "n_tokens", more("known", 0).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (more("base", 0.0) - F.col("n_tokens") * norm).alias("base_score"), "score")
