import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline as P
from quillspark.llm import queries
from quillspark.llm.quality import quality_rules
from quillspark.llm.secrets import mask_secrets

from .test_filters import brute_leaks
from .test_near_dedup import brute
from .test_packing import check


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage's rows against plain Python on all that its predecessor kept."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9)))
    item = [(i, " ".join(word() for _ in range(30))) for i in range(4)]
    docs = []
    for i in range(80):
        w = [word() for _ in range(r.randint(5, 200))]
        if i % 9 == 0:
            w[3:3] = item[i % 4][1].split()[2:22]
        if i % 7 == 0:
            w.insert(4, "token=abcdef" + str(i) + "aa")
        docs.append((i, " ".join(w)))
    docs += [(100 + i, t + " tail") for i, t in docs[:10]] + [(200, "same words " * 40), (201, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(item, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(docs)
    columns = frame.columns
    kept = P.quality(spark, frame, str(tmp_path))
    want = {x.doc_id for x in quality_rules(frame).where("kept").collect()}
    assert {x.doc_id for x in kept.collect()} == want and kept.columns == columns and 200 not in want and 201 not in want
    once = P.near_dedup(spark, kept, str(tmp_path))
    want = set(brute(sorted((i, texts[i]) for i in want)).values())
    assert {x.doc_id for x in once.collect()} == want and once.columns == columns
    clean = P.decontamination(spark, once, str(tmp_path))
    leaks = brute_leaks([(i, texts[i]) for i in want], item)
    want = {i for i in want if not leaks[i][3]}
    assert {x.doc_id for x in clean.collect()} == want and clean.columns == columns
    masked = P.secrets(spark, clean, str(tmp_path))
    got = {x.doc_id: x for x in masked.collect()}
    assert set(got) == want and all("token=abcdef" not in x.text and len(x.text) == x.n_chars for x in got.values())
    packed = P.run(spark, str(tmp_path)).collect()
    check(packed, 4096)
    assert {x.doc_id for x in packed} == want and mask_secrets(clean).columns == columns


def test_leaks_in_long_documents_go(spark, tmp_path):
    """A passage that is a hundredth of its document; a short item, which long documents may quote, goes by its share."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(4, 9)))
    items = [(0, " ".join(word() for _ in range(30))), (1, "common phrase here")]
    long = [word() for _ in range(1300)]
    passage = items[0][1].split()
    docs = [(0, long), (1, [*long[:700], *passage[5:18], *long[700:]]), (2, [*long[:700], *passage[5:17], *long[700:]]), (3, [*long, *items[1][1].split()]), (4, [*long[:20], *items[1][1].split()])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = P.decontamination(spark, spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), str(tmp_path))
    assert {x.doc_id for x in clean.collect()} == {0, 2, 3}


def test_queries_are_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
