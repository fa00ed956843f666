import random

import numpy as np
import pytest

from quarry.operators import selection


@pytest.mark.parametrize("bins", [2, 1024])
def test_percentiles_of_groups(spark, bins, monkeypatch):
    monkeypatch.setattr(selection.order_statistics, "__defaults__", (bins,))
    rng = random.Random(4)
    rows = [("a", rng.gauss(0, 1)) for _ in range(300)] + [("b", float(rng.randrange(4))) for _ in range(200)] + [(None, 2.5), ("one", -1.0), ("none", None), ("b", None)]
    rows += [("far", x) for x in (1e308, -1e308, 5e-324, 0.0, 1e-9, 7.0)]
    shares = (0.0, 0.5, 0.95, 0.99, 1.0)
    got = {r.g: r for r in selection.percentiles(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], shares).collect()}
    assert set(got) == {g for g, _ in rows}
    for g, r in got.items():
        values = sorted(v for h, v in rows if h == g and v is not None)
        assert r.n == len(values)
        for i, p in enumerate(shares):
            if not values:
                assert r[f"p{i}"] is None
            elif g != "far":
                assert abs(r[f"p{i}"] - np.quantile(values, p)) < 1e-12
    assert got["far"].p0 == -1e308 and got["far"].p4 == 1e308


def test_ranks_with_infinities_and_ties(spark):
    values = [float("-inf"), 3.0, 3.0, 3.0, 5.0, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = spark.createDataFrame([(k,) for k in range(1, 7)], "k long")
    assert {r.k: r.value for r in selection.order_statistics(df, ranks, []).collect()} == dict(enumerate(values, 1))


def test_nothing(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert selection.percentiles(empty, "x", ["g"], (0.5,)).collect() == []
    assert [tuple(r) for r in selection.percentiles(empty, "x", [], (0.5,)).collect()] == [(0, None)]
