"""What a Python worker holds does not grow with its share of the rows, nor with the number of queries beyond what it has to keep."""

import tracemalloc

import numpy as np
import pandas as pd

from quarry.operators import retrieval as R


def peak(run) -> float:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_nearest_of_many_queries_in_tiles():
    rng = np.random.default_rng(1)
    x, q = rng.integers(0, 4, (1500, 8)).astype(float), rng.integers(0, 4, (3000, 8)).astype(float)
    frames = lambda: iter([pd.DataFrame({"id": np.arange(a, b)[::-1], "embedding": list(x[a:b][::-1])}) for a, b in ((0, 3), (3, 1500))])
    run = R._nearest(list(range(3000)), q, 5, "l2")
    got = pd.concat(run(frames()))
    d = ((q[:, None] - x) ** 2).sum(2)
    assert (got["id"].to_numpy().reshape(3000, 5) == np.argsort(d, axis=1, kind="stable")[:, :5]).all()
    assert peak(lambda: list(run(frames()))) < 40


def test_missing_scores_come_last():
    best = R._Best([0], 3)
    best.add(np.array([[np.nan, 1.0]]), np.array([1, 2]))
    best.add(np.array([[np.nan, -np.inf]]), np.array([0, 3]))
    assert best.rows.tolist() == [[2, 3, 0]]


def test_words_held_are_bounded():
    words = [" ".join(f"w{i}" for i in range(a, a + 50_000)) for a in range(0, 400_000, 50_000)]
    parts = list(R._term_counts(iter([pd.DataFrame({"text": [w]}) for w in words])))
    assert max(map(len, parts)) <= R.WORDS_AT_ONCE + 50_001 and sum(p["df"].sum() for p in parts) == 400_000 + len(words)
    places = R._Places(64)
    assert [places[b"%d" % i] for i in range(250_000)][-1] == R._Places(64)[b"249999"] and len(places) <= R.WORDS_AT_ONCE
