import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import embeddings, ranker
from quarry.operators.retrieval import knn, words_of


def texts(n, seed):
    """Two topics, whose words keep to themselves."""
    rng = random.Random(seed)
    words = [[f"{t}{i}" for i in range(12)] for t in "ab"]
    return [" ".join(rng.choices(words[k % 2], k=rng.randrange(5, 40))) for k in range(n)] + ["", None, "rare words only here", "A0 a0"]


def dense_matrix(corpus, words, window):
    at, m = {w: i for i, w in enumerate(words)}, np.zeros((len(words), len(words)))
    for t in corpus:
        ids = [at.get(w) for w in (t or "").lower().split()]
        for i, a in enumerate(ids):
            for b in ids[i + 1 : i + 1 + window]:
                if a is not None and b is not None:
                    m[a, b] += 1
                    m[b, a] += 1
    s = m.sum(1)
    with np.errstate(divide="ignore"):
        return m, np.maximum(np.log(m * m.sum() / np.outer(s, s)), 0)


def test_vectors_against_a_whole_decomposition(spark):
    corpus = texts(120, 1)
    docs = spark.createDataFrame([(t, 1) for t in corpus], "text string, a int")
    words = embeddings.vocabulary(docs, 30, 2)
    df = Counter(w for t in corpus for w in set((t or "").lower().split()))
    want = sorted((w for w in df if df[w] >= 2), key=lambda w: (-df[w], w.encode()))[:30]
    names = [r.word for r in words.orderBy("place").collect()]
    assert names == want
    found = embeddings.associations(docs, words, 3)
    counts, pmi = dense_matrix(corpus, names, 3)
    got = {(r.a, r.b): (r.n, r.pmi) for r in found.collect()}
    assert set(got) == set(zip(*(x.tolist() for x in np.nonzero(pmi)), strict=True))
    assert all(n == counts[k] and math.isclose(p, pmi[k], rel_tol=1e-12) for k, (n, p) in got.items())
    x = np.random.default_rng(0).standard_normal((len(names), 3))
    assert np.allclose(embeddings.multiply(found, x), pmi @ x)
    u, s = embeddings.leading_vectors(found, len(names), 4)
    exact = np.linalg.svd(pmi)[1][:4]  # two topics: two values stand out, the others are close to each other
    assert np.allclose(s[:2], exact[:2], rtol=1e-6) and np.allclose(s, exact, rtol=1e-2)
    assert np.allclose(np.abs(pmi @ u)[:, :2], np.abs(u * s)[:, :2], atol=1e-3)  # eigenvectors, of either sign
    again, _ = embeddings.leading_vectors(found, len(names), 4)
    assert np.allclose(u, again)


def test_texts_of_a_topic_are_near(spark):
    docs = spark.createDataFrame([(t,) for t in texts(160, 2)], "text string")
    model = embeddings.learn(docs, dimensions=4, least_docs=2, window=3)
    rows = spark.createDataFrame([("a1 a2 a3",), ("a7 A8",), ("b1 b4 b5",), ("",), (None,), ("unknown",)], "text string").select(model.column(F.col("text")).alias("v")).collect()
    a, c, b, *none = (np.array(r.v) for r in rows)
    cosine = lambda x, y: x @ y / np.linalg.norm(x) / np.linalg.norm(y)
    assert cosine(a, c) > 0.9 > 0.3 > abs(cosine(a, b)) and not np.any(none)
    nothing = embeddings.learn(docs.limit(0), dimensions=4)
    assert nothing.of("a1").tolist() == [0.0] * 4


def test_gradient_by_differences():
    rng = np.random.default_rng(1)
    x, query, fits, w = rng.standard_normal((30, 4)), rng.integers(0, 4, 30), rng.random(30) < 0.4, rng.standard_normal(4)
    loss, g = ranker.loss_and_gradient(w, x, query, fits, 0.1)
    for i in range(4):
        e = np.eye(4)[i] * 1e-6
        assert abs((ranker.loss_and_gradient(w + e, x, query, fits, 0.1)[0] - ranker.loss_and_gradient(w - e, x, query, fits, 0.1)[0]) / 2e-6 - g[i]) < 1e-6


def test_features_and_relevance(spark):
    rows = [("a b c", "x A b  c y"), ("a b c", "c b a"), ("a", "a"), ("", "a"), ("a b", ""), (None, "a"), ("a b c d e f g h i", "z a b c d e f g h z"), ("a a", "a")]
    df = spark.createDataFrame(rows, "q string, t string").withColumn("body", ranker.body(F.col("t")))
    none = F.lit(None).cast("double")
    got = df.select(ranker.features(F.col("q"), F.col("body"), F.lit(0.5), none, F.lit(2), none).alias("x"), ranker.holds_passage(F.col("q"), F.col("body")).alias("fits")).collect()
    held = [tuple(round(v, 3) for v in r.x[:3]) for r in got]
    assert held == [(1, 1, 1), (1, 0, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (round(8 / 9, 3), 0.875, round(6 / 7, 3)), (1, 0, 0)]
    assert [bool(r.fits) for r in got] == [True, True, True, False, False, False, True, True]
    assert all(r.x[3:7] == [0.5, 0.0, 0.5, 0.0] for r in got)


def test_training_learns_what_tells_candidates_apart(spark):
    rng = random.Random(3)
    n = len(ranker.FEATURES)
    rows = []
    for q in range(60):
        for i in range(12):
            x = [rng.random() for _ in range(n)]
            rows.append((q, i, x, 2 * x[1] - x[4] + 0.1 * rng.gauss(0, 1) > 0.6))
    df = spark.createDataFrame(rows, "query_id long, id long, x array<double>, fits boolean")
    model = ranker.train(df.where("query_id < 40"))
    right = lambda m: np.mean([(np.dot(m.weights, a[2]) > np.dot(m.weights, b[2])) for a in rows for b in rows if a[0] == b[0] >= 40 and a[3] and not b[3]])
    assert right(model) > 0.95 > right(ranker.OVERLAP)
    shown = df.limit(1).select(model.score(F.col("x")).alias("s"), "x").first()
    assert math.isclose(shown.s, np.dot(model.weights, shown.x))
    assert ranker.train(df.where("query_id < 40")) == model
    assert ranker.train(df.where("not fits")) == ranker.OVERLAP and ranker.train(df.limit(0)) == ranker.OVERLAP


@pytest.mark.parametrize("window", [1, 5])
def test_no_pairs(spark, window):
    docs = spark.createDataFrame([("a",), ("a",)], "text string")
    words = embeddings.vocabulary(docs, 10, 1)
    assert embeddings.associations(docs, words, window).count() == 0


def test_words_found_as_they_are_split():
    odd = [None, "", " ", " a  B\tc\x0b", "a\x1cb a\x85c a\xa0b", "\x0cΑΣ ΑΣ. İ ß\r\n", "a b \x00 a\x00b", "𝒳 é É"]
    every = sorted({w for t in odd for w in words_of(t)})
    place = {w: i for i, w in enumerate(every) if i % 4}
    got = [(int(x), n) for at, words in embeddings._Found(place).parts(odd) for x, n in zip(at, np.repeat(np.arange(len(words)), words), strict=True) if x >= 0]
    assert got == [(place[w], k) for k, t in enumerate(odd) for w in words_of(t) if w in place]


def test_pairs_come_by_tiles(spark, monkeypatch):
    """What is shuffled and stored is a row a tile, not one a pair; the product in tiles is that of the whole matrix."""
    rng = random.Random(4)
    corpus = [" ".join(f"w{int(rng.paretovariate(0.4)) % 700}" for _ in range(rng.randrange(60))) for _ in range(300)] + [None, "", "w1 w1 w1"]
    docs = spark.createDataFrame([(t,) for t in corpus], "text string")
    words = embeddings.vocabulary(docs, 600, 1)
    names = [r.word for r in words.orderBy("place").collect()]
    monkeypatch.setattr(embeddings, "PAIRS_AT_ONCE", 5000)
    parts = list(embeddings._pairs({w.encode(): i for i, w in enumerate(names)}, 4)(iter([pa.RecordBatch.from_pydict({"text": pa.array(corpus, pa.string())})])))
    assert all(p.num_rows <= 136 for p in parts)
    counts, pmi = dense_matrix(corpus, names, 4)
    matrix = embeddings.Pairs(docs, words, 4)
    assert len(names) > 16 * 16 and matrix.stored.count() <= 136 < np.count_nonzero(pmi)
    assert matrix.sums.tolist() == counts.sum(1).tolist()
    got = {(r.a, r.b): r.n for r in matrix.rows().collect()}
    assert got == {(a, b): counts[a, b] for a, b in zip(*(x.tolist() for x in np.nonzero(pmi)), strict=True)}
    x = rng.random() * np.arange(len(names) * 5.0).reshape(-1, 5)
    assert np.allclose(embeddings.multiply(matrix, x), pmi @ x)


def test_each_text_is_embedded_once(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, None), (3, "b c")], "id long, text string")
    embed = embeddings.WordVectors({b"a": 0, b"b": 1}, np.eye(2), np.ones(2)).column
    found = knn(texts.select("id", embed(F.col("text")).alias("embedding")), texts.select(F.col("id").alias("query_id"), F.lit([1.0, 0.0]).alias("embedding")).limit(1), 3)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.id for r in found.orderBy("rank").collect()] == [1, 2, 3]
    nulls = spark.createDataFrame([(1, None), (2, [1.0, 1.0]), (3, None)], "id long, embedding array<double>")
    assert [r.id for r in knn(nulls, nulls.where("id > 1").withColumnRenamed("id", "query_id"), 3).collect()] == [2]


def test_documents_of_words_are_combined(monkeypatch):
    """Of a word there is a row whenever a task's memory is full, not one for each of its batches."""
    rng = random.Random(6)
    corpus = [" ".join(f"É{rng.randrange(90)}" for _ in range(rng.randrange(30))) + rng.choice(["", " ", "\t"]) for _ in range(400)] + [None, "", " "]
    batches = lambda: (pa.RecordBatch.from_pydict({"text": pa.array(corpus[k : k + 50], pa.string())}) for k in range(0, len(corpus), 50))
    want = Counter(w for t in corpus for w in set(words_of(t)))
    for least, most in ((1_000_000, len(want)), (200, 5 * len(want))):
        monkeypatch.setattr(embeddings, "TERMS_AT_ONCE", least)
        rows = [r for b in embeddings._documents_of(batches()) for r in b.to_pylist()]
        got = Counter()
        for r in rows:
            got[r["term"]] += r["df"]
        assert got == want and len(rows) <= most


def test_all_queries_train_the_ranker_to_the_minimum(spark):
    """with a sample of 500 queries the 300 that contradict the others would hardly count; what is found is the minimum over all of them."""
    rng = random.Random(5)
    n = len(ranker.FEATURES)
    rows = []
    for q in range(800):
        for i in range(4):
            x = [rng.random() for _ in range(n)]
            rows.append((q, i, x, (x[1] if q % 8 < 5 else x[2]) > 0.5))
    df = spark.createDataFrame(rows, "query_id long, id long, x array<double>, fits boolean")
    model = ranker.train(df)
    x, query, fits = np.array([r[2] for r in rows]), np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    scale = x.std(0)
    loss, g = ranker.loss_and_gradient(np.array(model.weights) * scale, x / scale, query, fits, 1e-3)
    assert np.linalg.norm(g) < 1e-5 and loss < math.log(2)
    assert model == ranker.train(df.repartition(7))


def test_a_short_query_fits_by_its_words_a_long_one_by_a_run(spark):
    """a trained ranker has to see what lets a short query's candidates fit, or it does worse than the share of words held."""
    long = [f"w{i}" for i in range(20)]
    rows = [("a b c", "c x b x a", 1 / 16, 1.0), ("a b c", "a b x", 2 / 16, 0.0), (" ".join(long), " ".join(["x", *long[3:12], "y", *long[:2]]), 9 / 16, 0.0)]
    rows += [(" ".join(long), " ".join(reversed(long)), 1 / 16, 1.0), (" ".join(long), " ".join(long), 1.0, 1.0), ("", "a", 0.0, 0.0), (None, "", 0.0, 0.0), ("a a a b", "a a b", 3 / 16, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, q string, t string, run double, every double").withColumn("body", ranker.body(F.col("t")))
    none = F.lit(None).cast("double")
    got = df.select(ranker.features(F.col("q"), F.col("body"), none, none, none, none).alias("x")).orderBy("i").collect()
    at = [ranker.FEATURES.index(f) for f in ("longest_run", "all_held")]
    assert [[r.x[k] for k in at] for r in got] == [[r[2], r[3]] for r in rows]


def test_precision_over_queries_of_any_length(spark, tmp_path):
    """the whole query, on a table with short items, partial passages and items that nothing fits."""
    from quarry.plans.retrieval import ranker_precision

    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(rng.choices(words, k=rng.choice((2, 3, 4, 5, 20, 30)))) for _ in range(120)]
    docs = [" ".join(rng.choices(words, k=rng.randrange(10, 60))) for _ in range(300)]
    for t in items:
        w = t.split()
        n = rng.randrange(2, len(w) + 1)
        docs.append(" ".join(rng.choices(words, k=20) + w[:n] + rng.choices(words, k=20)))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shown = sum(zlib.crc32(str(i).encode()) % 3 == 0 for i in range(120))
    assert [tuple(r) for r in ranker_precision(spark, str(tmp_path)).collect()] == [(120 - shown, True)]
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{tmp_path}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert [tuple(r) for r in ranker_precision(spark, f"{tmp_path}/none").collect()] == [(120 - shown, True)]
