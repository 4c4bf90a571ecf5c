import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers
from tokenizers import Tokenizer

from quillspark.llm import bpe
from quillspark.llm.packing import pack, plan

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(found, capacity):
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by


def test_encoder_equals_library(monkeypatch):
    r = random.Random(5)
    letters = [*"abcdeABC'srtmdvl019 _-!?.,#<|>\n\t\x0b\x1c\x85\xa0éÉßŒİıǅΣσς你好🙂́ªµ²½", "<|endoftext|>", "'re", "'ll"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 50))) for _ in range(3000)] + [t or "" for _, t in ODD]
    library = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    for memo in (100, 400_000):  # the smaller one changes generations all the time
        monkeypatch.setattr(bpe, "MEMO", memo)
        encoder = bpe.WordEncoder(PATH)
        for k in range(0, len(texts), 500):
            ids, n = encoder.encode(pa.array(texts[k : k + 500]))
            for t, got, e in zip(texts[k:], np.split(ids, np.cumsum(n)[:-1]), library[k:], strict=False):
                assert got.tolist() == e.ids, t[:80]


def test_pack_odd_rows(odd, none):
    found = pack(odd, capacity=64).collect()
    check(found, 64)
    library = Tokenizer.from_file(PATH)
    want = []
    for i, t in ODD:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=repr) == sorted(want, key=repr)
    assert pack(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    """The runs give as many sequences as best fit decreasing does document by document."""
    r = random.Random(seed)
    capacity = r.choice([7, 40, 100])
    counts = {s: r.randint(1, 60) for s in r.sample(range(1, capacity + 1), r.randint(1, min(25, capacity)))}
    gaps = []
    for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= size]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - size)
        else:
            gaps.append(capacity - size)
    table, used, filled = plan(counts, capacity), {}, {}
    for k, (size, rank, first, offset, each) in enumerate(table):
        end = table[k + 1][1] if k + 1 < len(table) and table[k + 1][0] == size else counts[size]
        for idx in range(end - rank):
            s, at = first + idx // each, offset + idx % each * size
            used.setdefault(s, []).append((at, size))
            filled[size] = filled.get(size, 0) + 1
    assert filled == counts and len(used) == len(gaps)
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
