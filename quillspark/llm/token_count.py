"""Token counts by a finite-state transducer compiled from the vocabulary, without building tokens.

Two deterministic automata run over each text. The first cuts it into pre-tokens: its eight states read character
classes (white space and apostrophes carry one or two characters of look-ahead in their class), a text is cut into
chunks, each chunk's map from entry state to exit state is found for all states at once, the maps compose through a
parallel prefix scan, and every chunk then runs from its true state. The second counts the tokens of a pre-token: its
transitions are annotated with the number of tokens by which the count changes. A state holds, for every start from
which a longer token could still come, that start's path in the vocabulary, the last token before it and the count
there, relative to now; merging proceeds by validity of neighbouring tokens, so a prefix has one last token and states
are finitely many. States and transitions are compiled when first met and kept by the worker. All pre-tokens of a
batch run in step, one byte of each at a time.
"""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .common import bounded_batches
from .bpe import _byte_chars

LIMIT = 1024
CHUNK = 128
# Classes of characters: letter, number, other, white space with more of it behind, last blank, last other white space,
# apostrophe with one more character of a contraction, with two more.
L, N, O, WS, LAST_BLANK, LAST_WS, A1, A2 = range(8)
# States: after a closed pre-token, in letters, in numbers, in others, behind a blank that may lead, in white space,
# one and two characters before the end of a contraction.
END, IN_L, IN_N, IN_O, LEAD, IN_WS, C1, C2 = range(8)
START = 8  # added to the next state where the character begins a pre-token


def _cutter() -> np.ndarray:
    """next[state, class], with START."""
    fresh = {L: IN_L, N: IN_N, O: IN_O, WS: IN_WS, LAST_BLANK: LEAD, LAST_WS: END, A1: C1, A2: C2}
    out = np.zeros((8, 8), np.uint8)
    for state in range(8):
        for c, to in fresh.items():
            out[state, c] = to + START
    out[IN_L, L], out[IN_N, N], out[IN_WS, WS] = IN_L, IN_N, IN_WS
    out[IN_O, [O, A1, A2]] = IN_O
    out[LEAD, [L, N, O, A1, A2]] = [IN_L, IN_N, IN_O, IN_O, IN_O]
    out[C1], out[C2] = END, C1
    return out


CUT = _cutter()
_TABLE: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        table = np.full(sys.maxunicode + 1, O, np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))[0]
            if kind in "LN":
                table[c] = L if kind == "L" else N
        table[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WS
        _TABLE = table
    return _TABLE


def classes(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The class of each character; ends: places behind the last character of each text."""
    c = _classes()[points]
    n = len(c)
    last = np.zeros(n, bool)
    last[ends[ends > 0] - 1] = True
    after = np.full(n + 2, -1, np.int64)
    after[: n - 1] = points[1:]
    one = np.where(last, -1, after[:n])
    follows = np.append(c[1:], WS)
    white = (c == WS) & ~last & (follows != WS)
    c = c.copy()
    c[white] = np.where(points[white] == 32, LAST_BLANK, LAST_WS)
    quote = np.flatnonzero((points == 39) & ~last)
    if len(quote):
        x = one[quote]
        second = np.where(last[np.minimum(quote + 1, n - 1)], -1, after[quote + 1])
        c[quote[np.isin(x, [115, 116, 109, 100])]] = A1
        two = ((x == 114) & (second == 101)) | ((x == 118) & (second == 101)) | ((x == 108) & (second == 108))
        c[quote[two]] = A2
    return c


def starts_of(c: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin. first: places of the first character of each text, where the automaton is reset."""
    n = len(c)
    reset = np.zeros(n, bool)
    reset[first[first < n]] = True
    chunks = -(-n // CHUNK)
    # A text's first character acts alike from any state: as from END.
    padded = np.full(chunks * CHUNK, L, np.uint8)
    padded[:n] = c
    resets = np.zeros(chunks * CHUNK, bool)
    resets[:n] = reset
    padded, resets = padded.reshape(chunks, CHUNK), resets.reshape(chunks, CHUNK)
    to = CUT & 7
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for k in range(CHUNK):
        maps[resets[:, k]] = END
        maps = to[maps, padded[:, k][:, None]]
    width = 1
    while width < chunks:  # prefix scan: map of chunks 0..i as a composition of maps of twice the width each round
        maps[width:] = np.take_along_axis(maps[width:], maps[:-width].astype(np.int64), 1)
        width *= 2
    state = np.append(END, maps[:-1, END]).astype(np.uint8)
    out = np.empty((CHUNK, chunks), bool)
    for k in range(CHUNK):
        state[resets[:, k]] = END
        state = CUT[state, padded[:, k]]
        out[k] = state >= START
        state &= 7
    return np.flatnonzero(out.T.ravel()[:n] | reset)


class Transducer:
    """Counts the tokens of byte strings; transitions are compiled when first met."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        self.special = [t["content"] for t in whole["added_tokens"]]
        back = {c: b for b, c in enumerate(_byte_chars())}
        raw = lambda t: bytes([back[c] for c in t])
        self.vocab = {raw(t): i for t, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.vocab[raw(a)], self.vocab[raw(b)]): (r, self.vocab[raw(a) + raw(b)]) for r, (a, b) in enumerate(pairs)}
        self.bytes_of = {i: t for t, i in self.vocab.items()}
        # The vocabulary as a tree: child[node][byte]; token[node]; root 0.
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for t, i in self.vocab.items():
            if self._ids(list(t)) != [i]:
                continue  # never made by merges
            node = 0
            for b in t:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = i
        self.valid: dict[int, bool] = {}
        start = ((0, -1, 0),)
        self.states, self.numbers = [start], {start: 0}
        self.made: dict[int, int] = {}
        self._table(1 << 16)

    def _ids(self, data: list[int]) -> list[int]:
        """Plain merging, for short strings at compile time."""
        ids = [self.vocab[bytes([b])] for b in data]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda k: self.ranks.get((ids[k], ids[k + 1]), (1 << 30,))[0])
            found = self.ranks.get((ids[best], ids[best + 1]))
            if not found:
                break
            ids[best : best + 2] = [found[1]]
        return ids

    def _follows(self, a: int, b: int) -> bool:
        """Whether merging leaves the tokens a, b side by side."""
        key = a << 20 | b
        if key not in self.valid:
            self.valid[key] = self._ids(list(self.bytes_of[a] + self.bytes_of[b])) == [a, b]
        return self.valid[key]

    def _step(self, state: int, byte: int) -> int:
        """Compile a transition: number of the next state << 8 | change of the count + 128."""
        kept, token, count = [], -1, 0
        for node, before, rel in self.states[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            t = self.token[to]
            if t >= 0 and token < 0 and (before < 0 or self._follows(before, t)):
                token, count = t, rel + 1
            if self.child[to]:
                kept.append((to, before, rel))
        assert token >= 0, "a byte without a token"
        following = (*[(node, before, rel - count) for node, before, rel in kept], (0, token, 0))
        number = self.numbers.get(following)
        if number is None:
            number = self.numbers[following] = len(self.states)
            self.states.append(following)
        out = number << 8 | count + 128
        self.made[state << 8 | byte] = out
        return out

    def _table(self, size: int) -> None:
        """The transitions as an open-addressing table."""
        self.size = size
        keys = np.full(size, -1, np.int64)
        values = np.zeros(size, np.int64)
        self.keys, self.values = keys, values
        if self.made:
            self._insert(np.fromiter(self.made.keys(), np.int64, len(self.made)), np.fromiter(self.made.values(), np.int64, len(self.made)))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) & (self.size - 1)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            own = self.keys[at] == keys
            self.values[at[own]] = values[own]
            keys, values, at = keys[~own], values[~own], (at[~own] + 1) & (self.size - 1)

    def _next(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = self.values[at]
        todo = np.flatnonzero(found != keys)
        while len(todo):
            empty = found[todo] == -1
            if empty.any():
                fresh = np.unique(keys[todo[empty]])
                made = np.array([self._step(k >> 8, k & 255) for k in fresh.tolist()], np.int64)
                if 2 * len(self.made) > self.size:
                    self._table(self.size * 4)
                    return self._next(keys)
                self._insert(fresh, made)
                out[todo[empty]] = made[np.searchsorted(fresh, keys[todo[empty]])]
                todo = todo[~empty]
            at[todo] = (at[todo] + 1) & (self.size - 1)
            found[todo], out[todo] = self.keys[at[todo]], self.values[at[todo]]
            todo = todo[found[todo] != keys[todo]]
        return out

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece (not empty) of ``data``."""
        order = np.argsort(starts - ends, kind="stable")  # longest first: those that run on are a prefix
        starts, lengths = starts[order], (ends - starts)[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        longer = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(order) else 0) + 1), "right")
        for k, live in enumerate(longer.tolist()):
            step = self._next(state[:live] << 8 | data[starts[:live] + k])
            state[:live] = step >> 8
            total[:live] += (step & 255) - 128
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


_TRANSDUCERS: dict[str, Transducer] = {}


def count_tokens(machine: Transducer, texts: list[str]) -> np.ndarray:
    """Tokens of each text."""
    extra = np.zeros(len(texts), np.int64)
    parts, row = [], []
    for k, t in enumerate(texts):
        pieces = [t]
        for s in machine.special:  # such a string is one token, and what is beside it is cut alone
            if s in t:
                pieces = [x for p in pieces for x in p.split(s)]
        extra[k] = len(pieces) - 1
        parts += pieces
        row += [k] * len(pieces)
    points = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    if not len(points):
        return extra
    begins = starts_of(classes(points, ends), ends - np.array([len(p) for p in parts]))
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    offset = np.append(0, np.cumsum(width))
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    n = machine.counts(data, offset[begins], offset[np.append(begins[1:], len(points))])
    owner = np.array(row)[np.searchsorted(ends, begins, "right")]
    return extra + np.bincount(owner, n, len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document.

    A null text counts as empty. A special token's string in a text is that one token, as the library has it by
    default. Ids may be null or repeat, and so may rows. Other columns are ignored; an empty table gives no rows.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    bounded_batches(docs.sparkSession)
    def run(batches):
        if path not in _TRANSDUCERS:
            _TRANSDUCERS[path] = Transducer(path)
        for batch in K.slices(batches, "text", 2_000_000):
            n = count_tokens(_TRANSDUCERS[path], batch.column("text").to_pylist())
            size = np.diff(K.buffer_of(batch.column("text"))[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
