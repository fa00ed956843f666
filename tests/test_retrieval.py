import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import relevance as M
from quarry.operators import retrieval as R


def okapi(docs, query):
    toks = {i: t.lower().split() for i, t in docs.items()}
    n, mean = len(docs), sum(map(len, toks.values())) / len(docs)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {w: floor if v < 0 else v for w, v in idf.items()}
    return {i: sum(idf.get(q, 0) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for q in query.lower().split()) for i, t in toks.items()}


DOCS = {1: "the cat sat on the mat", 2: "the dog and the cat", 3: "the the the", 4: "Birds fly over water", 5: "", 6: "a dog"}


@pytest.mark.parametrize("query", ["cat dog", "the the cat", "nothing here", "", "THE"])
def test_bm25_by_hand(spark, query):
    docs = spark.createDataFrame(list(DOCS.items()), "id long, text string")
    got = R.bm25(docs, spark.createDataFrame([(9, query)], "query_id long, text string"), 4).orderBy("rank").collect()
    want = okapi(DOCS, query)
    order = sorted(DOCS, key=lambda i: (-round(want[i], 9), i))[:4]
    assert [r.id for r in got] == order
    best = max(want.values())
    assert all(math.isclose(r.score, want[r.id], abs_tol=1e-8) and math.isclose(r.normalised, round(want[r.id] / (best if best > 0 else 1), 4), abs_tol=1.1e-4) for r in got)


def test_knn_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).astype("float32")
    v = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(x)] + [(900, None, 1), (901, [0.0] * 8, 1)], "id long, embedding array<float>, label int")
    q = v.where("id < 40").select(F.col("id").alias("query_id"), "embedding")
    monkeypatch.setattr(R, "QUERIES_AT_ONCE", 7)
    for metric in ("cosine", "l2"):
        got = R.knn(v, q, 3, metric, F.col("label") == 1).collect()
        assert len(got) == 120
        for i in (0, 17, 39):
            own = [j for j in [*range(300), 901] if j == 901 or j % 3 == 1]
            y = np.array([x[j] if j < 300 else np.zeros(8) for j in own], float)
            s = -((y - x[i]) ** 2).sum(1) if metric == "l2" else np.nan_to_num(y @ x[i].astype(float) / (np.linalg.norm(y, axis=1) * np.linalg.norm(x[i].astype(float)) + 1e-300))
            best = sorted(range(len(own)), key=lambda k: (-round(s[k], 9), own[k]))[:3]
            assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == [own[k] for k in best]
    assert R.knn(v, q.limit(0), 3).count() == 0


def results(spark, rows):
    return spark.createDataFrame(rows, "query_id long, id long, score double, rank int").withColumn("normalised", F.col("score"))


def test_fusion_ties_and_one_sided(spark):
    dense = results(spark, [(1, 10, 0.8, 1), (1, 11, 0.6, 2), (1, 12, 0.6, 3)])
    sparse = results(spark, [(1, 20, 0.8, 1), (1, 11, 0.2, 2), (1, 21, 0.6, 3)])
    got = [(r.id, r.score) for r in R.fuse(dense, sparse, 5).orderBy("rank").collect()]
    assert got == [(10, 0.4), (11, 0.4), (20, 0.4), (12, 0.3), (21, 0.3)]
    by = [r.id for r in R.fuse_by_distance(dense, sparse, 2).orderBy("rank").collect()]
    assert by[0] == 20 or by[0] == 10
    same = results(spark, [(1, 1, 1.0, 1), (1, 2, 1.0, 2)])
    assert [r.score for r in R.fuse_by_distance(same, sparse.limit(0), 5).collect()] == [0.0, 0.0]


def test_threshold_and_fallback(spark):
    r = results(spark, [(1, 1, 0.5, 1), (1, 2, 0.1, 2), (2, 3, 0.1, 1), (2, 4, 0.05, 2)]).drop("normalised")
    assert sorted((x.query_id, x.id, x.rank) for x in R.above(r, 0.2, 1).collect()) == [(1, 1, 1), (2, 3, 1)]
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    out = R.with_fallback(r.where("query_id < 3"), q, lambda left: left.select("query_id", F.lit(7).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")))
    assert sorted((x.query_id, x.id, x.fallback) for x in out.collect())[-1] == (3, 7, True)


def test_rerank_keeps_rank_on_ties(spark):
    rows = spark.createDataFrame([(1, 5, 1, "red fox", "a fox"), (1, 6, 2, "red fox", "the red fox"), (1, 7, 3, "red fox", "one fox")], "query_id long, id long, rank int, query string, text string")
    got = R.rerank(rows, 3).orderBy("rank").collect()
    assert [r.id for r in got] == [6, 5, 7] and got[0].score == round(1 / (1 + math.exp(-4)), 4)


@pytest.mark.parametrize(
    "doc,truth,want",
    [
        (("movie_5", "", "zzz"), "5", True), (("5", "", "zzz"), "5", True), (("1", "Alien", "zzz"), "the alien film", True), (("1", "", ""), "anything", True), (("1", "", "some text"), "", False), (("1", "", "some text"), None, False),
        (("1", "", "aaaa bbbb cccc dddd"), "aaaa bbbb xxxx", False),  # 2 of 5: not above 0.4
        (("1", "", "aaaa bbbb cccc dddd"), "aaaa bbbb cccc xxxx", True), (("1", "", "it is so"), "is it", False),
    ],
)
def test_relevance(spark, doc, truth, want):
    row = spark.createDataFrame([(*doc, truth)], "id string, title string, text string, truth string")
    assert row.select(M.is_relevant(*map(F.col, ("id", "title", "text", "truth")))).first()[0] is want


def test_tier1(spark):
    found = spark.createDataFrame([(1, 1, "a", "", "gold text", 0.5), (1, 2, "b", "", "other", 0.25), (2, 1, "c", "", "none", 0.1), (3, 1, "d", "", "x y", 0.0)], "query_id long, rank int, id string, title string, text string, similarity double")
    truths = spark.createDataFrame([(1, "gold"), (1, "missing thing"), (2, "absent")], "query_id long, truth string")
    got = {r.query_id: tuple(r)[1:] for r in M.tier1(found, truths).collect()}
    assert got == {1: (True, 0.2, 0.5, 1.0, 0.375), 2: (False, 0.0, 0.0, 0.0, 0.1), 3: (False, 0.0, 1.0, 0.0, 0.0)}
