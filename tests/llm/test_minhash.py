import random
import re

import numpy as np
import pytest

from quarry.llm import minhash


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent=80):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, len(s), ids.get(find(i)), ids.get(find(i)) == d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def family(rng, n, edits, words=60):
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def rows_of(seed):
    rng = random.Random(seed)
    texts = [None, "", " \t", "a", "A", "a b", "é É", "a b a b", "b a b a", *family(rng, 60, 5), *family(rng, 40, 9), *family(rng, 5, 2, 3000), *(" ".join(f"u{rng.randrange(3000)}" for _ in range(50)) for _ in range(40))]
    texts += rng.choices(texts, k=30)
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, (3, texts[3]), (3, texts[4]), (None, texts[5]), (None, "only here with no id at all")]


@pytest.mark.parametrize(("nodes", "width"), [(512, 2), (4, 2), (512, 5)])  # the second: units are cut into pairs of blocks
def test_matches_brute_force(spark, monkeypatch, nodes, width):
    monkeypatch.setattr(minhash, "BLOCK_NODES", nodes)
    rows = rows_of(7)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr) == brute(rows, width)


def test_parts_of_a_key_beyond_one_block(spark, monkeypatch):
    """Families near the threshold, of which one comparison each joins few: the second round has to find the rest."""
    monkeypatch.setattr(minhash, "BLOCK_NODES", 3)
    rng = random.Random(11)
    rows = list(enumerate(family(rng, 50, 4, 40) + family(rng, 50, 7, 60)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 2)


def test_shingles_of_long_texts():
    words = [f"w{i % 90000}" for i in range(400_000)]
    known = minhash._Hashes()
    assert len(minhash.shingles("\n".join(words), known)) == len(set(zip(words, words[1:], strict=False)))
    assert (minhash.shingles("A  b\tC", known) == minhash.shingles("a b c", known)).all()
    assert len(minhash.shingles("a", known)) == 1 and len(minhash.shingles(" ", known)) == 0


def test_signatures_estimate_resemblance():
    rng = np.random.default_rng(0)
    every = rng.integers(0, 1 << 63, 6000).astype(np.uint64)
    a, b = np.sort(every[:5400]), np.sort(every[600:])  # 4800 of 6000
    f = minhash.functions(1)
    assert abs((minhash.signature(a, f) == minhash.signature(b, f)).mean() - 0.8) < 0.1


def test_empty_table_and_clashing_names(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c", 1, "x", 2), (2, "A b  c", 3, "y", 4)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n long, `set` string, node long"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    with pytest.raises(ValueError, match="missing"):
        minhash.near_duplicates(spark.range(1))
