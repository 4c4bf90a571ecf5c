"""Token counts, language-model scores and shards against brute force."""

import math
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import lm_scoring as M
from quillspark.llm import sharding as H
from quillspark.llm import token_count as T

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_counts_equal_library(odd, none):
    r = random.Random(3)
    letters = [*"abcdeABC'srtmdvl019 _-!?.,#<|>\n\t\x0b\x1c\x85\xa0éÉßŒİıǅΣσς你好🙂́ªµ²½ ", "<|endoftext|>", "'re", "'ll", "  ", "\n\n", " the"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4000)] + ["a" * 5000, " " * 3000, "\n" * 700, "x" * 300 + " " * 300, "", "ab" * 4000]
    library = Tokenizer.from_file(PATH)
    machine = T.Transducer(PATH)
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert T.count_tokens(machine, texts).tolist() == want
    got = sorted(((x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in T.token_counts(odd).collect()), key=repr)
    own = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in ODD]
    assert got == sorted(own, key=repr) and T.token_counts(none).count() == 0


def test_chunk_maps_compose():
    """The scan over chunks gives the same cuts as one automaton over the whole."""
    import numpy as np

    r = np.random.default_rng(0)
    for n in (1, 127, 128, 129, 5000):
        c = r.integers(0, 8, n).astype(np.uint8)
        first = np.unique(np.append(0, r.integers(0, n, 3)))
        state, out = T.END, []
        for i in range(n):
            state = T.END if i in first else state
            state = T.CUT[state, c[i]]
            if state >= T.START or i in first:
                out.append(i)
            state &= 7
        assert T.starts_of(c, first).tolist() == out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), None]


def test_base_scores(make, none, odd):
    r = random.Random(5)
    texts = [" ".join(r.choice(["the", "of", "Tion", "edé"]) + r.choice(["", "", str(r.randint(0, 50))]) for _ in range(r.randint(0, 200))) for _ in range(120)]
    found = {x.doc_id: x for x in M.score_documents(make(texts)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    c = Counter(w for i, t in enumerate(texts) if not held[i] for w in tokens(t))
    total, kinds = c.total(), len(c)
    for i, t in enumerate(texts):
        x, own = found[i], tokens(t)
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(own), sum(c[w] > 0 for w in own), total)
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own))
        assert x.score < 0
    assert M.score_documents(none).count() == 0
    assert M.score_documents(odd).count() == odd.count()


def test_base_scores_by_shuffle(make, monkeypatch):
    """With next to no frequent tokens the same scores come from the join."""
    texts = [f"the w{i % 7} of the {i}" for i in range(60)]
    a = {x.doc_id: (x.n_known, round(x.base_score, 6), round(x.score, 3)) for x in M.score_documents(make(texts)).collect()}
    monkeypatch.setattr(M, "FREQUENT", 3)
    b = {x.doc_id: (x.n_known, round(x.base_score, 6), round(x.score, 3)) for x in M.score_documents(make(texts)).collect()}
    assert a == b


def test_tree_is_a_distribution():
    """Every retained context's distribution sums to one, and longer contexts are kept where they tell more."""
    import numpy as np

    root = np.zeros(256, np.int64)
    root[[97, 98]] = 500, 500
    context, symbol, count = np.array([97, 97, 98, 98]), np.array([97, 98, 97, 98]), np.array([10, 490, 490, 10])
    tree = M.SuffixTree(root, [(context, symbol, count)])
    assert len(tree.codes) == 3
    for state in range(3):
        p = 10.0 ** tree.look_up(np.full(256, state), np.arange(256))
        assert p.sum() == pytest.approx(1, abs=0.02 if state else 1e-9)
    even = M.SuffixTree(root, [(context, symbol, np.full(4, 250))])
    assert len(even.codes) == 1


def test_held_out_beats_unigrams_of_letters(make):
    """On held-out texts the tree predicts better than letters alone would."""
    r = random.Random(6)
    texts = [" ".join("".join(r.choice(["tion", "ing", "the", "ed"]) for _ in range(r.randint(1, 3))) for _ in range(150)) for _ in range(80)]
    found = [x for x in M.score_documents(make(texts)).collect() if x.held_out]
    c = Counter("".join(texts))
    flat = sum(math.log10(c[ch] / c.total()) for x in found for ch in texts[x.doc_id])
    assert sum(x.score for x in found) > 0.7 * flat


def greedy(sizes, capacity):
    n, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return 10**9
        if s > room:
            n, room = n + 1, capacity
        room -= s
    return n


@pytest.mark.parametrize("detail,n,shards", [(32, 300, 10), (256, 2000, 10), (1 << 15, 500, 10), (4096, 20_000, 40), (1 << 15, 60_000, 400), (1 << 15, 30_000, 4000)])
def test_smallest_capacity(spark, monkeypatch, detail, n, shards):
    """Equals the least capacity of a plain search over all groups, however coarse the intervals are."""
    monkeypatch.setattr(H, "DETAIL", detail)
    r = random.Random(detail)
    groups = sorted((u, r.randint(1, 5000)) for u in {r.randrange(H.SPAN) for _ in range(n)})
    sizes = [s for _, s in groups]
    low, high = max(sizes), sum(sizes)
    while low < high:
        m = (low + high) // 2
        low, high = (low, m) if greedy(sizes, m) <= shards else (m + 1, high)
    capacity, cuts = H.smallest_capacity(spark.createDataFrame(groups, "u long, bytes long").cache(), shards)
    assert capacity == low and len(cuts) < shards
    by = Counter()
    for u, s in groups:
        by[bisect_right(cuts, u - 1)] += s
    assert max(by.values()) <= capacity


def test_shards(make, odd, none):
    r = random.Random(4)
    texts = [("x" * r.randint(0, 4000)) + str(i % 700) for i in range(900)] + ["copy " * 400] * 400 + [None, "", ""]
    found = H.shard_documents(make(texts)).collect()
    assert len(found) == len(texts)
    by, place, size = {}, {}, Counter()
    for x in found:
        raw = (texts[x.doc_id] or "").encode()
        assert (x["size"], x.text_crc32, x.law, x.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= x.shard < 40
        by.setdefault(raw, set()).add(x.shard)
        place.setdefault(x.shard, []).append(x.slot)
        size[x.shard] += x["size"]
    assert all(len(s) == 1 for s in by.values()) and all(sorted(s) == list(range(len(s))) for s in place.values())
    giant = next(iter(by[b"copy " * 400]))
    rest = [size[s] for s in range(40) if s != giant]
    assert max(rest) - sum(rest) / 39 < 5000 and min(rest) > 0.6 * max(rest)
    assert H.shard_documents(odd).count() == odd.count() and H.shard_documents(none).count() == 0


def test_bounds_are_bisected():
    order = H._Order([(63, 0, 1, 5), (63, 1, 1, 5), (62, 1, 3, 30)])
    assert order.walk(10, 2) == ([10, 10], [10, 20]) and order.verdict(40, 1) is True and order.verdict(9, 2) is False
    assert bisect_right(order.ends, 10) == 3
