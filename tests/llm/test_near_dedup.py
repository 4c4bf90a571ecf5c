import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quillspark.llm import near_dedup as N
from quillspark.llm import textkernels as K


def bag(text):
    w = text.encode().lower().split()
    return Counter(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute(texts):
    """The least id of each document's component under links of 0.8 or more; null texts alone."""
    label = {i: i for i, _ in texts}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    full = [(i, t, bag(t)) for i, t in texts if t is not None]
    for k, (i, t, a) in enumerate(full):
        for j, u, b in full[:k]:
            c = (a & b).total()
            if t == u or (a and b and 100 * c >= 80 * (a.total() + b.total() - c)):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in texts}


def test_signature_is_weighted_jaccard():
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(2000)]
    a = [words[i] for i in r.integers(0, 2000, 300)]
    b = [*a[:100], "x", *a[101:]]
    for x, y in ((a, b), (a * 3, a * 2), (a * 5 + b, a * 7), (a, a[:150])):
        keys = N.bags(*N.shingles(*K.buffer_of(pa.array([" ".join(x), " ".join(y)]))))
        s = N.signatures(*keys, 2, 6000)
        p, q = bag(" ".join(x)), bag(" ".join(y))
        assert abs((s[0] == s[1]).mean() - (p & q).total() / (p | q).total()) < 0.03


def test_groups_equal_brute_force(make):
    r = random.Random(4)
    base = [[r.choice("abcdefghijklmnop") * r.randint(1, 4) + str(r.randint(0, 300)) for _ in range(120)] for _ in range(12)]
    texts = []
    for b in base:
        chain = list(b)
        for _ in range(r.randint(1, 8)):  # chains: each near the one before
            texts.append(" ".join(chain))
            for _ in range(2):
                chain[r.randrange(len(chain))] = "new" + str(r.randint(0, 10**6))
    texts += [texts[0]] * 5 + ["short one"] * 3 + ["", "", " "]
    r.shuffle(texts)
    pairs = list(enumerate(texts)) + [(len(texts), None), (len(texts) + 1, None)]
    found = N.near_duplicates(make(pairs), bands=20, rows=5).collect()  # takes more than one round
    assert {x.doc_id: x.class_id for x in found} == brute(pairs)
    assert sorted(x.doc_id for x in found if x.kept) == sorted(set(brute(pairs).values()))


def test_large_bucket_of_unlike_documents(make):
    """Many documents share a passage, so buckets mix classes; none is dropped and no link is lost."""
    r = random.Random(9)
    common = [f"c{i}" for i in range(60)]
    pairs = []
    for i in range(60):
        own = [f"o{r.randint(0, 10**6)}" for _ in range(40)]
        pairs += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common + own[:-1] + ["z"]))]
    found = N.near_duplicates(make(pairs), bands=8, rows=2).collect()  # coarse bands: many rounds
    assert {x.doc_id: x.class_id for x in found} == brute(pairs)


def test_group_of_edited_copies(make, monkeypatch):
    """Copies with edits of their own, copies of copies, and prefixes of one text: classes as by brute force."""
    monkeypatch.setattr(N, "SMALL", 60)  # some steps by pivots
    r = random.Random(21)
    new = lambda: "n" + str(r.randint(0, 10**7))
    base = [f"b{r.randint(0, 10**5)}" for _ in range(150)]
    texts = []
    for k in range(40):
        w = list(base)
        for _ in range(r.randint(1, 7)):
            w[r.randrange(len(w))] = new()
        texts.append(" ".join(w))
        if k % 10 == 0:  # edits that several share
            for _ in range(4):
                v = list(w)
                v[r.randrange(len(v))] = new()
                texts.append(" ".join(v))
    texts += [" ".join(base[:k]) for k in range(60, 150, 10)] + [" ".join(base[k:] + [new() for _ in range(40)]) for k in range(0, 60, 20)]
    r.shuffle(texts)
    pairs = list(enumerate(texts))
    found = N.near_duplicates(make(pairs), bands=40, rows=2).collect()
    assert {x.doc_id: x.class_id for x in found} == brute(pairs)


def test_recall_at_the_registered_settings(make):
    """Of the pairs of similarity 0.8 or more, at least 0.99 are in one class."""
    r = random.Random(22)
    pairs, near = [], 0
    for k in range(150):
        w = [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(60, 200))]
        v = list(w)
        for _ in range(r.randint(1, max(1, len(w) // 45))):
            v[r.randrange(len(v))] = f"x{r.randint(0, 10**6)}"
        pairs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    want = brute(pairs)
    found = {x.doc_id: x.class_id for x in N.near_duplicates(make(pairs)).collect()}
    close = [k for k in range(150) if want[2 * k + 1] == 2 * k]
    assert len(close) > 75 and sum(found[2 * k + 1] == 2 * k for k in close) >= 0.99 * len(close)
    assert all(found[2 * k + 1] == 2 * k + 1 for k in range(150) if k not in close)


def test_hot_pivots_and_texts(make, monkeypatch):
    """Pivots and texts that are spread over tasks give the same classes."""
    monkeypatch.setattr(N, "HOT", 7)
    r = random.Random(23)
    base = [f"b{i}" for i in range(120)]
    pairs = [(i, " ".join([*base[: i % 100], f"n{i}", *base[i % 100 + 1 :]])) for i in range(60)] + [(100 + i, " ".join(base)) for i in range(30)] + [(200 + i, f"lone {r.random()}") for i in range(5)]
    found = N.near_duplicates(make(pairs)).collect()
    assert {x.doc_id: x.class_id for x in found} == brute(pairs)


def test_keep_one_passes_columns_through(make):
    kept = N.keep_one(make([(777, "a b c d e f"), (778, "q r s t u v")]))
    assert {r["__uid"] for r in kept.collect()} == {3}


def test_odd_rows(odd, none):
    found = N.near_duplicates(odd)
    assert found.count() == odd.count() and N.near_duplicates(none).count() == 0
    got = {(r.doc_id, r.class_id) for r in found.collect()}
    assert (5, 4) in got and (2, 2) in got and (3, 3) in got and (1, 1) in got
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(4) == 1 and 5 not in ids and {1, 2, 3, 6, 7, 8, None} <= set(ids)


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5000, 5000)]
    found = N.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r.node: r.root for r in found}
    assert len({roots[i] for i in range(201)}) == 1 and len({roots[1000 + k] for k in range(300)}) == 1 and len(set(roots.values())) == 2


def test_only_units_in_question_become_rows(spark, monkeypatch):
    """A pivot's members with units of their own: rows for those that two classes share, also when spread over tasks."""
    r = random.Random(24)
    rows = [(1, 5, d, 1, d % 3, 9, 9, [r.randint(-(2**31), 2**31 - 1) for _ in range(30)] + [d % 4, 100 + d % 3]) for d in range(200)]
    near = spark.createDataFrame(rows, "pivot long, ph long, doc long, deg long, label long, c long, only long, added array<int>")
    for most in (N.HOT_UNITS, 1000):
        monkeypatch.setattr(N, "HOT_UNITS", most)
        found = N._by_unit(near).collect()
        groups = {}
        for x in found:
            groups.setdefault(x.bucket, set()).add(x.doc)
        assert len(found) == 200 and sorted(map(sorted, groups.values())) == [list(range(k, 200, 4)) for k in range(4)]


def test_pivots_are_taken_once(make, monkeypatch):
    """Classes of a group with chains of edits are those of brute force, in two steps, however small a task's share is."""
    rng = np.random.default_rng(11)
    base, docs = [f"w{i}" for i in range(120)], []
    for _ in range(12):  # edits in common, over those of each document's own
        some = [w if rng.random() > 0.03 else f"e{rng.integers(0, 9)}" for w in base]
        docs += [" ".join(w if rng.random() > 0.01 else f"x{rng.integers(0, 99)}" for w in some) for _ in range(9)]
    monkeypatch.setattr(N, "SMALL", 2)
    steps, following = [], N._following
    monkeypatch.setattr(N, "_following", lambda *a: steps.append(1) or following(*a))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(make(list(enumerate(docs)))).collect()}
    wanted = brute(list(enumerate(docs)))
    assert len(steps) == 1 and 1 < len(set(wanted.values())) < len(docs) and got == wanted
