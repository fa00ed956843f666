import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language
from quarry.llm.language import BiGru, bytes_of, has_letter, identify, pooled, windows


def test_gradients_by_differences():
    model = BiGru(["a", "b", "c"], hidden=3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    rng = np.random.default_rng(0)
    x = rng.integers(97, 103, (6, 4))
    x[4:, 1] = language.PAD
    y = np.array([0, 1, 2, 0])
    states = BiGru.states

    def exact(self, x, d, keep=None):  # in double precision
        return states(self, x, d, keep).astype(np.float64)

    model.states = exact.__get__(model)
    _, grad = model.gradients(x, y)
    for k in model.w:
        for at in list(np.ndindex(model.w[k].shape))[:: max(1, model.w[k].size // 12)]:
            if k.startswith("x") and not np.isin(at[0], x):
                continue
            was = model.w[k][at]
            losses = []
            for e in (1e-3, -1e-3):
                model.w[k][at] = was + e
                losses.append(model.gradients(x, y)[0])
            model.w[k][at] = was
            assert abs((losses[0] - losses[1]) / 2e-3 - grad[k][at]) < 2e-3, (k, at)


@pytest.mark.parametrize("margin", [0, 16])
def test_pooling_reads_every_byte_once(margin):
    model = BiGru(["a", "b"], hidden=4)
    texts = [bytes_of(t) for t in ("x" * 1000, "ab", "", "é" * 77, "y" * 96, "z" * 97)]
    got = pooled(model, texts, 96, margin, at_once=3)
    assert np.allclose(got.sum(1), [1, 1, 0, 1, 1, 1], atol=1e-5)
    alone = pooled(model, [texts[3]], 96, margin)
    assert np.allclose(alone[0], got[3], atol=1e-5)


def test_windows_overlap_and_count_each_byte_once():
    rng = np.random.default_rng(3)
    for width, margin in ((96, 0), (96, 16), (10, 3), (7, 0)):
        texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, width - 1, width, width + 1, 5 * width, 777, width + margin)]
        x, of, counts = windows(texts, width, margin)
        for d, t in enumerate(texts):
            own = [x[counts[:, k], k] for k in np.flatnonzero(of == d)]
            assert np.concatenate([*own, np.empty(0, np.int16)]).tolist() == t.tolist()
            for k, w in enumerate(np.flatnonzero(of == d)):
                first, last = np.flatnonzero(counts[:, w])[[0, -1]]
                assert k == 0 or first >= margin  # context before
                assert k == (of == d).sum() - 1 or last < width - margin  # and after


def test_windows_change_little():
    """A position with context says about what it says in the whole text."""
    rng = np.random.default_rng(4)
    model = BiGru(["a", "b", "c"], hidden=6)
    texts = [rng.integers(97, 123, n).astype(np.uint8) for n in (300, 5000)]
    whole = [pooled(model, [t], len(t))[0] for t in texts]
    assert np.abs(pooled(model, texts, 192, 16) - whole).max() < 0.002


@pytest.fixture(scope="module")
def result(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs, identify(docs).toPandas()


def test_held_out_accuracy(result):
    docs, out = result
    both = out.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert [zlib.crc32(str(d).encode()) % 3 == 1 for d in both["doc_id"]] == both["held_out"].tolist()
    assert len(held) > 250 and (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert out["score"].between(0, 1).all()


def test_label_source_and_held_out_rows_are_not_used(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = docs.withColumn("lang", F.when(fold, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    assert sorted(map(tuple, identify(docs).collect())) == sorted(map(tuple, identify(other).collect()))


def test_rows_that_share_an_id_all_count(spark):
    """Thousands of labelled rows under one id are as good a sample as any."""
    word = {"en": "the house and the garden ", "de": "das Haus und der Garten "}
    learnt = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1)
    rows = [(learnt, f"{word[n] * 3}{i}", n) for i in range(2000) for n in word]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train_language_model(df, sample_rows=200, steps=120)
    out = df.where("text like '%7'").select("lang", language.predict(model, F.col("text")).alias("p"))
    assert out.where("lang = p.lang_pred").count() == out.count() > 300


def test_very_long_text(spark, result):
    docs, _ = result
    model = language.train_language_model(docs)
    german = docs.where("lang = 'de' and length(text) > 500").first().text
    df = spark.createDataFrame([(1, (german + " ") * (3_000_000 // len(german)))], "doc_id long, text string")
    assert df.select(language.predict(model, F.col("text")).alias("p")).first().p.lang_pred == "de"


def test_edge_cases(spark):
    learnt = [i for i in range(100, 140) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, t, n) for i, (t, n) in zip(learnt, [("the house and the garden", "en"), ("das Haus und der Garten", "de")] * 3, strict=False)]
    rows += [(1, None, "en"), (2, "", "en"), (3, "12 34 ?!", "de"), (4, "the house and the garden", "en"), (5, "das Haus und der Garten", "de"), (None, "the end", None), (4, "the house and the garden", "en"), (6, "²", None), (7, "дом", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = {(r["doc_id"], r["lang_pred"] == "und") for r in identify(df).collect()}
    assert {(1, True), (2, True), (3, True), (6, True), (4, False), (7, False), (None, False)} <= out
    assert identify(df).count() == len(rows) and identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert has_letter("é") and not has_letter("²1") and not has_letter(None)
