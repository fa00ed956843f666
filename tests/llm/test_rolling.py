import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from quarry.llm import rolling

SCHEMA = "id long, g string, t long, value long, label string"
SHARES = ((1, 2), (90, 100))


def brute(rows, windows):
    out = []
    for i, g, t, _, _ in rows:
        for w in windows:
            own = [r for r in rows if t is not None and r[1] == g and r[2] is not None and t - w <= r[2] < t]
            values = sorted(r[3] for r in own if r[3] is not None)
            m = len(values)
            ranks = [values[math.ceil(m * a / b) - 1] if m else None for a, b in SHARES]
            out.append((i, w, t, len(own), sum(values), len({r[4] for r in own} - {None}), *ranks))
    return sorted(out, key=repr)


def some_rows(n, seed, span=300):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(i // 2, pick("a", "a", "b", None), rng.randrange(-span, span), pick(None, 0, rng.randrange(50), rng.randrange(10**9)), pick(None, "x", "y", "z")) for i in range(n)]


@pytest.mark.parametrize("weighted", [False, True])
def test_tree(weighted):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 50):
        values, weights = rng.integers(0, 20, n), rng.integers(1, 4, n) if weighted else np.ones(n, np.int64)
        tree = rolling.MergeSortTree(values, weights if weighted else None)
        for a in range(n):
            for b in range(a + 1, n + 1):
                every = np.sort(np.repeat(values[a:b], weights[a:b]))
                k = np.arange(1, len(every) + 1)
                assert (tree.select(np.full(len(k), a), np.full(len(k), b), k) == every).all()
                v = np.arange(-1, 22)
                assert (tree.within(np.full(len(v), a), np.full(len(v), b), tree.place(v)) == np.searchsorted(every, v)).all()


@pytest.mark.parametrize("at_once", [1 << 18, 5])  # the second: tiles are split by value and label
def test_windows_match_brute_force(spark, at_once):
    rows = some_rows(160, 1) + [(999, "a", None, 5, "x")]
    got = rolling.rolling_ranks(spark.createDataFrame(rows, SCHEMA), (7, 60), SHARES, at_once)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, (7, 60))


def test_ties_and_repeats_are_one_point(spark):
    rows = [(1, "a", 10, 4, "x")] * 300 + [(2, "a", 11, 1, None)] * 2 + [(3, None, 11, None, None)]
    got = rolling.rolling_ranks(spark.createDataFrame(rows, SCHEMA), (5,), SHARES)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, (5,))


def test_times_are_exact():
    for i in (0, 1, 5, 6, 12345, 10**12 + 7):
        h = zlib.crc32(str(i).encode())
        assert 60 * math.floor((i + h % 10000) / 6) == 10 * (i + h % 10000 - (i + h % 10000) % 6)


def test_documents(spark):
    docs = [Row(doc_id=i, text=None if i % 7 == 0 else "é" * (i % 5), lang=("en", None, "de")[i % 3], source=("s", None)[i % 2], g=1, t=2, id=3, value=4) for i in [*range(60), 5, 5, 8]] + [Row(doc_id=None, text="a", lang="en", source="s", g=1, t=2, id=3, value=4)]
    got = rolling.document_windows(spark.createDataFrame(docs), (600, 43200)).collect()
    seconds = lambda i: None if i is None else 60 * ((i + zlib.crc32(str(i).encode()) % 10000) // 6)
    want = brute([(d.doc_id, d.source, seconds(d.doc_id), None if d.text is None else len(d.text), d.lang) for d in docs], (600, 43200))
    assert sorted(map(tuple, got), key=repr) == want


def test_empty(spark):
    assert rolling.rolling_ranks(spark.createDataFrame([], SCHEMA), (5,)).collect() == []
    with pytest.raises(ValueError, match="missing"):
        rolling.document_windows(spark.range(1), (5,))
