import gc
import random
import weakref

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval as R
from quarry.operators import text_index, vector_index
from quarry.sources.store import scratch


def some_vectors(n=1500, d=32, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, d)) * 2
    return centres[rng.integers(0, 30, n)] + rng.standard_normal((n, d))


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(9000, None)], "id long, embedding array<float>")


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_vector_index_against_exact_search(spark, monkeypatch, metric):
    v = frame(spark, some_vectors())
    q = v.where("id % 20 = 0 and id < 9000").select(F.col("id").alias("query_id"), "embedding")
    folder = scratch(spark)
    vector_index.build(v, folder, lists=16, codes=8, values=64, metric=metric, sample_rows=1000)
    exact = {(r.query_id, r.rank): r for r in R.knn(v, q, 5, metric).collect()}
    found = vector_index.search(spark, folder, q, 5, probes=8, refine=10)
    assert vector_index.recall(found, R.knn(v, q, 5, metric)).first().recall >= 0.9
    for r in found.collect():  # scores are exact, and no rank is better than the exact one
        assert r.score <= exact[r.query_id, r.rank].score + 1e-9
    everything = vector_index.search(spark, folder, q, 5, probes=16, refine=300).collect()  # nothing is cut off: the exact result
    assert {(r.query_id, r.rank): r.id for r in everything} == {k: r.id for k, r in exact.items()}
    monkeypatch.setattr(vector_index, "QUERIES_AT_ONCE", 20)  # the same in several blocks
    again = vector_index.search(spark, folder, q, 5, probes=8, refine=10).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, found.collect()))
    assert vector_index.search(spark, folder, q.limit(0), 5).count() == 0


def test_vector_index_edges(spark):
    x = np.array([[1.0, 0, 0, 0]] * 40 + [[0.0] * 4] * 3 + [[0, 1.0, 0, 0]])  # one vector has nearly all rows
    v, folder = frame(spark, x), scratch(spark)
    vector_index.build(v, folder, lists=8, codes=2, values=4)
    q = spark.createDataFrame([(1, [2.0, 0.0, 0.0, 0.0]), (2, [0.0] * 4), (3, [0.0, 3.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    got = vector_index.search(spark, folder, q, 3, probes=8).collect()
    want = R.knn(v, q, 3).collect()
    assert {(r.query_id, r.rank): r.score for r in got} == {(r.query_id, r.rank): r.score for r in want}
    assert next(r.id for r in got if r.query_id == 3 and r.rank == 1) == 43
    with pytest.raises(ValueError, match="no vector"):
        vector_index.build(v.where("embedding is null"), folder)
    with pytest.raises(ValueError, match="divide"):
        vector_index.build(v, folder, codes=3)


def test_codes_approximate_vectors():
    x = some_vectors(800, 16)
    model = vector_index.Quantiser.fit(x, 12, 8, 32, "l2", 1)
    own, codes = model.encode(x)
    assert ((x - model.decode(own, codes)) ** 2).sum() < 0.25 * ((x - model.centroids[own]) ** 2).sum()
    again = vector_index.Quantiser.fit(x, 12, 8, 32, "l2", 1)
    assert (again.centroids == model.centroids).all() and (again.books == model.books).all()


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(n)]


@pytest.mark.parametrize(("shard", "block"), [(16_384, 32), (90, 4), (7, 1)])
def test_text_index_is_bm25(spark, shard, block):
    docs = [*texts(400, 1), (1000, ""), (1001, None), (None, "w399 w398"), (5, "w1 w2")]
    df = spark.createDataFrame(docs, "id long, text string").repartition(3)
    queries = spark.createDataFrame([(1, "w300 w399 w7"), (2, "W1 w1 w0"), (3, "absent"), (4, ""), (5, None), (6, "w390"), *((i + 10, t) for i, t in texts(12, 9))], "query_id long, text string")
    folder = scratch(spark)
    text_index.build(df, folder, shard, block)
    got, read = text_index.search(spark, folder, queries, 5)
    want = R.bm25(df, queries, 5)
    row = lambda r: (r.query_id, r.rank, r.id, round(r.score, 8), r.normalised)
    assert sorted(map(row, got.collect())) == sorted(map(row, want.collect()))
    n = read.agg(F.sum("postings").alias("n"), F.sum("of").alias("of")).first()
    assert n["n"] < n["of"] if block < 32 else n["n"] <= n["of"]


def test_text_index_in_blocks_of_queries_and_empty(spark, monkeypatch):
    df, folder = spark.createDataFrame(texts(60, 2), "id long, text string"), scratch(spark)
    text_index.build(df, folder, 16, 4)
    queries = spark.createDataFrame(texts(9, 3), "query_id long, text string")
    want = sorted(map(tuple, text_index.search(spark, folder, queries, 3)[0].collect()))
    monkeypatch.setattr(text_index, "TEXT_QUERIES_AT_ONCE", 2)
    assert sorted(map(tuple, text_index.search(spark, folder, queries, 3)[0].collect())) == want
    assert text_index.search(spark, folder, queries.limit(0), 3)[0].count() == 0
    with pytest.raises(ValueError, match="bm25"):  # every word is in every document
        text_index.build(spark.createDataFrame([(1, "a b"), (2, "b a"), (3, "a b")], "id long, text string"), folder)
        text_index.search(spark, folder, queries, 3)


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    """What goes to the tasks for one block of queries is gone before the next one's is made."""
    held, most = [], []

    def watched(name, argument):
        made = getattr(R, name)

        def run(*args):
            gc.collect()
            most.append(sum(ref() is not None for ref in held))
            held.append(weakref.ref(args[argument]))
            return made(*args)

        monkeypatch.setattr(R, name, run)

    watched("_nearest", 1)
    watched("_okapi", 2)
    monkeypatch.setattr(R, "QUERIES_AT_ONCE", 5)
    monkeypatch.setattr(R, "TEXT_QUERIES_AT_ONCE", 5)
    v = frame(spark, some_vectors(60, 4))
    R.knn(v, v.where("id < 40").select(F.col("id").alias("query_id"), "embedding"), 2)
    docs = spark.createDataFrame(texts(30, 4), "id long, text string")
    R.bm25(docs, docs.withColumnRenamed("id", "query_id"), 2)
    assert len(held) > 12 and max(most) <= 1
    keys = docs.select(F.col("id").alias("query_id"), F.col("text").alias("keyword"))
    whole = sorted(map(tuple, R.keyword_totals(docs, keys).collect()))
    assert sorted(map(tuple, R.keyword_totals(docs, keys, at_once=4).collect())) == whole


def test_substrings_by_trigrams(spark, tmp_path):
    """The index finds what a search through all texts does, from one shard or many, and after it was loaded again."""
    from quarry.operators import substring_index

    rows = [(i, t) for i, t in enumerate(t for _, t in texts(40, 6))] + [(90, None), (91, ""), (92, "ab"), (93, "\U0001f600x\U0001f600 É né"), (93, "\U0001f600x\U0001f600 É né"), (94, "aba" * 400_000)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "id long, text string, gram string")
    held = [t.lower() for _, t in rows if t is not None]
    words = sorted({w for t in held[:9] for w in t.split()[:4]}) + ["", "a", "ab", "\U0001f600X\U0001f600", "é n", "nowhere", "bab" * 50, "bab" + "aab" * 2, held[3], None, "AB"]
    keys = spark.createDataFrame(list(enumerate(words)), "query_id int, keyword string")
    want = sorted((i, n) for i, w in enumerate(words) if w is not None and (n := sum(w.lower() in t for t in held)))
    for shard in (50, 2_000_000):
        index = substring_index.build(docs, str(tmp_path / str(shard)), shard)
        assert sorted(map(tuple, index.totals(keys).collect())) == want
    assert sorted(map(tuple, substring_index.load(spark, str(tmp_path / "50")).totals(keys, at_once=8).collect())) == want
    assert index.postings.select("shard").distinct().count() < substring_index.load(spark, str(tmp_path / "50")).postings.select("shard").distinct().count()
    # candidates are few beside all texts: a word that most texts lack is verified on those alone that hold its trigrams
    word = spark.createDataFrame([("nowhere",), ("\U0001f600x\U0001f600",)], "word string")
    assert index.candidates(word).count() == 2


def test_substrings_of_nothing(spark):
    from quarry.operators import substring_index

    index = substring_index.build(spark.createDataFrame([], "text string"))
    assert index.totals(spark.createDataFrame([(1, "abc"), (2, "")], "query_id int, keyword string")).collect() == []
