"""The suffix tree: contexts over word ends, growth with the corpus, the same tree by joins."""

import random
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import lm_scoring as M


def test_contexts_run_over_word_ends(make):
    """Texts whose words always come in one order are likelier in it than shuffled."""
    ring = ["un", "deux", "trois", "quatre"]
    texts = {i: " ".join(ring[(i + k) % 4] for k in range(40)) for i in range(60)}
    texts[100], texts[101] = " ".join(ring * 10), " ".join(ring[::-1] * 10)
    found = {x.doc_id: x.score for x in M.score_documents(make(list(texts.items()))).collect()}
    assert found[100] > found[101] + 5


def test_tree_grows_with_the_corpus(spark):
    """Twice the corpus in another alphabet: twice the candidates, none lost to a share of the whole."""
    r = random.Random(9)
    word = lambda a: "".join(r.choice(a) for _ in range(3))
    sizes = []
    for parts in (1, 2):
        docs = [" ".join(word(alphabet) for _ in range(20_000)) for alphabet in ("abcdefgh", "ijklmnop")[:parts]]
        counted = M.count_all(spark.createDataFrame([(d,) for d in docs], "text string"))
        sizes.append([level.select("context").distinct().count() for level in M.candidates(counted)])
    assert sum(sizes[1]) > 1.9 * sum(sizes[0])


def test_tree_by_joins(make, monkeypatch):
    """A tree too large for memory gives the same scores."""
    r = random.Random(10)
    texts = [" ".join(r.choice(["the", "of", "Tion", "edé"]) + r.choice(["", str(r.randint(0, 9))]) for _ in range(r.randint(0, 200))) for _ in range(150)]
    texts += ["", None, "never seen"]
    shown = lambda: {x.doc_id: (round(x.base_score, 5), round(x.score, 4)) for x in M.score_documents(make(texts)).collect()}
    a = shown()
    monkeypatch.setattr(M, "TREE_ROWS", 0)
    assert shown() == a


def test_windows_without_longer_contexts_share_a_look_up():
    """Remembered scores equal the tree's; of windows that differ only before what the tree knows, one is looked up."""
    r = np.random.default_rng(11)
    levels = []
    for depth in range(1, M.DEPTH + 1):  # "a"s before "a" or "b": each depth tells more
        context = np.full(2, sum(97 << 8 * k for k in range(depth)), np.int64)
        levels.append((context, np.array([97, 98]), np.array([10_000 // 3**depth + 9, 10_000 - 10_000 // 3**depth])))
    tree = M.SuffixTree(np.bincount([97, 98], [5000, 5000], 256).astype(np.int64), levels)
    assert (tree.codes >> 8 * M.DEPTH > M.SHORT).any()
    some = np.array([0, 97, 97, 97, 97, 97, 98, 255], np.uint8)[r.integers(0, 8, (20_000, 8))]
    some[::2, 2:] = some[0, 2:]  # many that differ in what comes first
    windows = np.ascontiguousarray(some[:, ::-1]).view(np.int64).ravel()
    asked, look_up = [], tree.window_scores
    tree.window_scores = lambda keys: asked.append(len(keys)) or look_up(keys)
    memo = M.Memo(tree)
    for _ in range(2):
        assert np.array_equal(memo(windows), look_up(windows))
    assert sum(asked) < len(np.unique(windows)) * 0.9


def test_look_ups_search_pieces():
    """Scores come from the sorted pieces alone, to the last bit, also of windows that no text has."""
    r = np.random.default_rng(12)
    levels = []
    for depth in range(1, M.DEPTH + 1):
        context = np.unique(r.choice([97, 98, 255], (40, depth)) @ (1 << 8 * np.arange(depth)))
        symbol = np.tile([97, 98, 255], len(context))
        levels.append((np.repeat(context, 3), symbol, r.integers(1, 5000, len(symbol))))
    tree = M.SuffixTree(np.bincount([97, 98, 255], [5000, 4000, 3000], 256).astype(np.int64), levels)
    some = r.choice(np.array([97, 98, 255, 0, 10], np.uint8), (50_000, 8), p=[0.4, 0.3, 0.2, 0.05, 0.05])
    windows = np.append(np.ascontiguousarray(some).view(np.int64).ravel(), r.integers(-(2**63), 2**63 - 1, 1000))
    want, asked = tree.window_scores(windows), []
    tree.window_scores = lambda keys: asked.append(len(keys))
    assert np.array_equal(M.Memo(tree)(windows), want) and not asked
    assert len(M.Memo(tree)(windows[:0])) == 0


@pytest.mark.parametrize("held", [M.HELD, 300])
def test_counts_go_by_buckets(spark, monkeypatch, held):
    """Counts equal brute force at every depth, whatever a task holds, and a shuffled row is a bucket, not a window."""
    r = random.Random(13)
    texts = [" ".join("".join(r.choice("abé") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 400))) for _ in range(40)] + ["", None, "Odd words"]
    monkeypatch.setattr(M, "HELD", held)
    monkeypatch.setattr(M, "BUCKETS", 16)
    words, windows = Counter(), [Counter() for _ in range(M.DEPTH + 1)]
    for text in texts:
        own = [w.encode() for w in (text or "").lower().split(" ") if w]
        words.update([*own, b"\n"])
        data = b" " * M.DEPTH + b"".join(w + b" " for w in own) + b"\n"
        for i in range(M.DEPTH, len(data)):
            for d in range(M.DEPTH + 1):
                windows[d][data[i - d : i][::-1], data[i]] += 1
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    sent = M._counted(docs)
    assert sent.count() < len(windows[M.DEPTH]) / (20 if held == M.HELD else 1)
    assert all(0 <= x.bucket < 32 for x in sent.collect())
    counted = M.count_all(docs)
    assert sorted(x.n for x in counted.where("kind = 0").collect()) == sorted(words.values())
    for d, level in enumerate(M.candidates(counted)):
        follow = Counter()
        for (context, _), n in windows[d].items():
            follow[context] += n
        want = {(int.from_bytes(c, "little"), s): n for (c, s), n in windows[d].items() if not d or follow[c] >= M.LEAST_COUNT}
        found = level.collect()
        assert len(found) == len(want) and {(x.context, x.symbol): x.n for x in found} == want


def test_tree_in_parts(make, monkeypatch):
    """A tree goes to the executors in parts of a bounded size that overlap in short contexts only; scores are the same."""
    r = random.Random(14)
    texts = [" ".join(r.choice(["the", "of", "Tion", "edé", "你好"]) + r.choice(["", str(r.randint(0, 9))]) for _ in range(r.randint(0, 300))) for _ in range(150)] + ["", None, "never seen"]
    sizes, build = [], M.in_memory

    def built(counts, kept):
        sizes.append(len((tree := build(counts, kept)).entries) - 256)
        return tree

    monkeypatch.setattr(M, "in_memory", built)
    shown = lambda: {x.doc_id: (x.n_tokens, round(x.base_score, 6), round(x.score, 6)) for x in M.score_documents(make(texts)).collect()}
    a = shown()
    whole = sizes.pop()
    monkeypatch.setattr(M, "TREE_ROWS", whole // 4)
    monkeypatch.setattr(M, "PART_ROWS", whole // 4)
    assert shown() == a
    assert len(sizes) >= 4 and max(sizes) < whole // 4 + 7 * 256 and whole <= sum(sizes) < 2 * whole
