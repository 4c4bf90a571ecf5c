"""Byte-pair encoding of whole batches, for the vocabulary whose tokens carry a word-end mark.

The library's own encoder takes tens of microseconds a word. Here a batch is cut into pieces (runs of letters, single
digits, runs of signs, all lower-cased) by byte classes, pieces are known by 64-bit hashes, and those that are new to
the worker are merged together, a merge of each piece at a time; everything is NumPy, nothing is done word by word. What
is known is kept in two generations of bounded size: when the younger is full it becomes the older one, whose pieces
come over as they are met again. The tokenizer drops white space and its tokens don't reach over it, so a chunk between
white space that holds anything else (apostrophes, what could be a special token, other scripts) is one piece that the
slower path or the library itself encodes; very long pieces go to the library too.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa

from . import textkernels as K

NONE = np.int64(1) << np.int64(40)
LONGEST = 48
#: Pieces of a generation.
MEMO = 400_000
#: Pieces that are merged together.
AT_ONCE = 200_000
GAP, LETTER, DIGIT, SIGN, OTHER = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[33:127] = SIGN
_CLASS[97:123] = LETTER
_CLASS[65:91] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[[39, 60]] = OTHER
_CLASS[[9, 10, 11, 12, 13, 32]] = GAP
#: Words are cut on the pattern of the tokenizer, spelled out for lower-cased Latin text.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_LATIN = re.compile("[\x21-\x3b\x3d-\x7eÀ-ÖØ-öø-įı-ɏ]+")


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.old = self.young = _Known()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | place in keys, for each pair; NONE without a merge."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at] << 20 | at, NONE)

    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, how many each has) of the pieces (of one byte at least) in data."""
        lengths = ends - starts
        sizes, made = np.zeros(len(starts), np.int64), []
        for n in np.unique(lengths):
            who = np.flatnonzero(lengths == n)
            raw = data[starts[who][:, None] + np.arange(n)]
            ids = self.inner[raw]
            ids[:, -1] = self.final[raw[:, -1]]
            ranks = self._rank(ids[:, :-1], ids[:, 1:])
            while len(who):
                width = ids.shape[1]
                best = ranks.argmin(1) if width > 1 else None
                live = ranks[np.arange(len(who)), best] < NONE if width > 1 else np.zeros(len(who), bool)
                if not live.all():
                    sizes[who[~live]] = width
                    made.append((who[~live], ids[~live].astype(np.uint32)))
                    who, ids, ranks = who[live], ids[live], ranks[live]
                    best = best[live] if width > 1 else None
                    if not len(who):
                        break
                rows = np.arange(len(who))
                new = self.made[ranks[rows, best] & 0xFFFFF]
                rest = np.arange(width - 1)
                ids = np.take_along_axis(ids, rest + (rest > best[:, None]), 1)
                ids[rows, best] = new
                rest = np.arange(width - 2)
                ranks = np.take_along_axis(ranks, rest + (rest >= best[:, None]), 1)
                a = np.flatnonzero(best > 0)
                ranks[a, best[a] - 1] = self._rank(ids[a, best[a] - 1], ids[a, best[a]])
                a = np.flatnonzero(best < width - 2)
                ranks[a, best[a]] = self._rank(ids[a, best[a]], ids[a, best[a] + 1])
        at = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.uint32)
        for who, ids in made:
            flat[at[who][:, None] + np.arange(ids.shape[1])] = ids
        return flat, sizes

    def slowly(self, chunks: list[str]) -> list[np.ndarray]:
        """The ids of chunks without white space: Latin ones by their pieces, others by the library."""
        out: list = [None] * len(chunks)
        pieces: dict[bytes, int] = {}
        cut: list[tuple[int, list[int]]] = []
        other: list[int] = []
        for k, c in enumerate(chunks):
            if len(c) > LONGEST or not _LATIN.fullmatch(c):
                other.append(k)
            else:
                cut.append((k, [pieces.setdefault(x.encode(), len(pieces)) for x in _PIECES.findall("".join([x.lower() for x in c]))]))
        if pieces:
            ends = np.cumsum([len(x) for x in pieces])
            flat, sizes = self.merge(np.frombuffer(b"".join(pieces), np.uint8), np.append(0, ends[:-1]), ends)
            each = np.split(flat, np.cumsum(sizes)[:-1])
            for k, own in cut:
                out[k] = np.concatenate([each[i] for i in own])
        if other:
            found = self.library.encode_batch_fast([chunks[k] for k in other], add_special_tokens=False)
            for k, e in zip(other, found, strict=True):
                out[k] = np.array(e.ids, np.uint32)
        return out

    def _new(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> None:
        """Learn pieces that aren't known yet."""
        odd = (classes == OTHER) | (ends - starts > LONGEST)
        order = np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])
        plain = int((~odd).sum())
        flat, sizes = [], []
        for k in range(0, plain, AT_ONCE):
            part = order[k : min(k + AT_ONCE, plain)]
            ids, n = self.merge(data, starts[part], ends[part])
            flat.append(ids)
            sizes.append(n)
        slow = self.slowly([data[starts[i] : ends[i]].tobytes().decode() for i in order[plain:]])
        flat += slow
        sizes.append(np.array([len(x) for x in slow], np.int64))
        self.young = self.young.joined(keys[order], np.concatenate(flat) if flat else np.zeros(0, np.uint32), np.concatenate(sizes))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in order, how many each row has) of a string array; a null has none."""
        raw, offsets = K.buffer_of(column)
        data, classes, starts, ends = pieces_of(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        coded = pa.array(K.word_hashes(data, starts, ends) ^ (classes[starts] == OTHER).astype(np.uint64)).dictionary_encode()
        which, keys = coded.indices.to_numpy(), coded.dictionary.to_numpy()
        first = np.empty(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        missing = np.flatnonzero(self.young.find(keys) < 0)
        known = self.old.find(keys[missing])
        again = known >= 0
        if len(self.young.keys) + len(missing) > MEMO:
            self.old, self.young = self.young, _Known()
            missing = np.arange(len(keys))
            known = self.old.find(keys)
            again = known >= 0
        if again.any():
            self.young = self.young.joined(keys[missing[again]], *self.old.ids_of(known[again]))
        fresh = missing[~again]
        if len(fresh):
            at = first[fresh]
            self._new(keys[fresh], data, starts[at], ends[at], classes[starts[at]])
        at = self.young.find(keys)[which]
        ids, sizes = self.young.ids_of(at)
        sums = np.append(0, np.cumsum(sizes))
        return ids, np.diff(sums[np.searchsorted(starts, offsets)])


class _Known:
    """Pieces' ids by hash: sorted keys, and where each one's ids lie."""

    def __init__(self, keys=None, at=None, sizes=None, ids=None):
        self.keys = np.zeros(0, np.uint64) if keys is None else keys
        self.at, self.sizes = (np.zeros(0, np.int32), np.zeros(0, np.int32)) if at is None else (at, sizes)
        self.ids = np.zeros(0, np.uint32) if ids is None else ids

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def ids_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[places].astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        return self.ids[np.repeat(self.at[places] - begins, sizes) + np.arange(int(sizes.sum()))], sizes

    def joined(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> _Known:
        at = len(self.ids) + np.cumsum(sizes) - sizes
        keys, at, sizes = np.append(self.keys, keys), np.append(self.at, at.astype(np.int32)), np.append(self.sizes, sizes.astype(np.int32))
        order = np.argsort(keys, kind="stable")  # two sorted runs but for the new keys
        return _Known(keys[order], at[order], sizes[order], np.append(self.ids, ids))


def pieces_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, classes, starts, ends): the pieces of all rows; letters are lower-cased, but in chunks of class OTHER."""
    data, classes = K.LOWER[raw], _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if len(raw) else np.zeros(0, np.int64)  # Latin-1 letters
    after = raw[lead + 1]
    letter = (after & 0x1F) != 0x17
    lead, after = lead[letter], after[letter]
    classes[lead] = classes[lead + 1] = LETTER
    data[lead + 1] = np.where(after < 0x9F, after + 0x20, after)
    chunk_starts, chunk_ends, _ = K.word_bounds(raw, offsets)
    if len(chunk_starts):
        odd = np.append(0, np.cumsum(classes == OTHER, dtype=np.int32))
        odd = np.flatnonzero(odd[chunk_ends] > odd[chunk_starts])
        lengths = chunk_ends[odd] - chunk_starts[odd]
        own = np.repeat(chunk_starts[odd] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        data[own], classes[own] = raw[own], OTHER
    new = np.empty(len(raw), bool)
    if len(raw):
        new[0] = True
        np.not_equal(classes[1:], classes[:-1], out=new[1:])
    new |= classes == DIGIT
    new[offsets[:-1][offsets[:-1] < len(raw)]] = True
    cuts = np.flatnonzero(new)
    ends = np.append(cuts[1:], len(raw))
    full = classes[cuts] != GAP
    return data, classes, cuts[full], ends[full]
