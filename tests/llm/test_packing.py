import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm.common import tokenizer_path
from quarry.llm.packing import Tokenizer, pack, plan

PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = ["", None, "hello, world!", "It's 12.5% of the <|endoftext|> <|ENDOFTEXT|> text", "Straße ÉCOLE İstanbul ſ K é Ǆ", "a\x1cb c d", "...!!! ((x)) don't 'S", "x" * 5000, "word " * 9000, "naïve, naïve. NAÏVE", "漢字 かな", "\x00 \x85  y"]


def whole(text):
    return Tokenizer(PATH).backend.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_are_the_tokenizer_s():
    t = Tokenizer(PATH)
    for _ in range(2):  # with and without remembered words
        for text in TEXTS:
            assert np.frombuffer(b"".join(t.encode(text or "")), "<u4").tolist() == whole(text)[:-1]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece(seed):
    rng = np.random.default_rng(seed)
    limit = 64
    sizes = np.minimum(limit, rng.geometric([0.05, 0.3, 0.02, 0.5, 0.01, 0.1][seed], 3000)) if seed != 3 else np.full(2000, 33)
    histogram = {int(k): int(v) for k, v in Counter(sizes.tolist()).items()}
    runs, n = plan(histogram, limit)
    filled = {}
    for x, count in histogram.items():
        below = [r[0] for r in runs[x]]
        assert below == sorted(below) and below[-1] == count
        for rank in range(count):
            _, shift, at = runs[x][next(i for i, b in enumerate(below) if rank < b)]
            filled.setdefault(rank + shift, []).append((at, x))
    assert sorted(filled) == list(range(n))
    for parts in filled.values():
        at = 0
        for start, x in sorted(parts):
            assert start == at
            at += x
        assert at <= limit
    least = -(-sum(sizes.tolist()) // limit)
    assert n <= (2000 if seed == 3 else 1.02 * least + 1)


def test_plan_of_nothing():
    assert plan({}, 4096) == ({}, 0)


def test_pieces_and_sequences(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "again"), (2, "again"), (None, "no id")] + [(100 + i, "the word " * (i % 50)) for i in range(300)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, length int")
    out = pack(df, PATH).collect()
    want = Counter()
    for d, t in rows:
        ids = whole(t)
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            want[(d, k // 4096, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= 4096
    assert len(sequences) <= -(-sum(r.length for r in out) // 4096) + 1
    assert pack(df.limit(0), PATH).count() == 0
