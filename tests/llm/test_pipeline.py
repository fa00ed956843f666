import os
import random
import re
import zlib

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, queries
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_simhash import brute_components, brute_fingerprint


def brute(rows, items, keep_language):
    """What the first four stages keep, on plain lists."""
    rows = [r for r in rows if keep_language(r)]
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
    rows = [min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"])) for g in groups.values()]
    ids = [r["doc_id"] for r in rows]
    near = corpus_pipeline.NEAR
    fps = [brute_fingerprint(r["text"], near["width"], near["seed"], near["words"]) for r in rows]
    part = brute_components(ids, fps, near["distance"])
    rows = [r for r, c in zip(rows, part, strict=True) if c == r["doc_id"]]
    hit = {h[0] for h in brute_hits([(r["doc_id"], r["text"]) for r in rows], items) if h[2]}
    return sorted(r["doc_id"] for r in rows if r["doc_id"] not in hit)


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(120)
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    stages = corpus_pipeline.STAGES
    assert [n for n, _ in stages] == ["language", "exact", "near", "decontaminate", "packing"]
    kept = docs
    for _, stage in stages[:-1]:
        kept = stage(spark, kept, small)
        assert kept.columns == docs.columns
        kept = corpus_pipeline.stash(kept, "test")
    spoken = {r["doc_id"] for r in stages[0][1](spark, docs, small).collect()}
    want = brute(docs.collect(), items, lambda r: r["doc_id"] in spoken)
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    packed = stages[-1][1](spark, kept, small).collect()
    assert sorted({r["doc_id"] for r in packed}) == want


def test_stages_with_nulls_repeats_and_empty_tables(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "the house and the garden are by the river and the old mill"
    rows = [(1, text, "en", "a", 3), (1, text, "en", "a", 3), (2, text + " ", "en", "b", 4), (3, None, "en", None, None), (4, "", "de", "a", 0), (None, "das Haus und der Garten am alten Fluss", "de", "c", 1), (5, "1 2 3", "de", "c", 1), (6, text + " today", None, "q", 9)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert stage(spark, docs.limit(0), small).count() == 0
        if name == "language":
            assert out.where("doc_id in (3, 4, 5)").count() == 0 and out.where("doc_id is null").count() == 1
        if name == "exact":
            assert sorted(map(repr, ([r["doc_id"] for r in out.collect()]))) == sorted(map(repr, [2, 3, None, 5, 6]))
        if name == "near":
            assert out.where("doc_id is null").count() == 1 and out.where("doc_id = 1").count() == 1
        if name == "packing":
            assert out.count() == len(rows)


def test_columns_may_have_any_name(spark, small):
    """Names that the stages use themselves, and types of all kinds."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    names = ["row", "n", "found", "id", "tie", "fp", "w0", "stays", "keep_id", "order", "chars", "__key"]
    more = docs.select("*", *(F.lit(i).alias(x) for i, x in enumerate(names)), F.array(F.lit(1)).alias("f"), F.struct(F.lit("x").alias("y")).alias("h"))
    for (name, stage), plain in zip(corpus_pipeline.STAGES[:-1], corpus_pipeline.STAGES[:-1], strict=True):
        out = stage(spark, more, small)
        assert out.columns == more.columns, name
        assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in plain[1](spark, docs, small).collect())
        assert out.where("n <> 1 or found <> 2 or h.y <> 'x'").count() == 0
    assert corpus_pipeline.packing(spark, more, small).count() > 0


def test_what_stays_does_not_depend_on_the_order(spark, small):
    text = "the house and the garden are by the river and the old mill"
    rows = [(1, text, lang, source, n) for lang in ("en", "de") for source in ("a", "b") for n in (1, 2)] + [(None, text, "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        kept = {tuple(stage(spark, spark.createDataFrame(own, schema).repartition(k), small).collect()[0]) for k, own in ((1, rows), (3, rows[::-1]), (2, rows[4:] + rows[:4]))}
        assert len(kept) == 1 and kept.pop()[0] == 1
        assert stage(spark, spark.createDataFrame(rows, schema), small).count() == 1


def test_run_leaves_nothing_but_what_its_result_reads(spark, tmp_path, small):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").limit(60).write.parquet(f"{tmp_path}/{name}.parquet")
    since = common.mark()
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in common.made()[since:] if os.path.exists(p.removeprefix("file:"))]
    assert [x for x in left if x.startswith("stage-")] == ["stage-decontaminate"] and not any(x.startswith(("near", "exact", "simhash")) for x in left)
    assert out.count() > 0


def test_near_copies_are_caught(spark, small):
    """Copies with some words replaced, of a resemblance of 0.8 or more by words of five: nine in ten go, whatever the place of the changes."""
    rng = random.Random(3)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 600").orderBy("doc_id").limit(250).collect()]
    shingles = lambda t: {tuple(t[i : i + 5]) for i in range(len(t) - 4)}
    rows, copies = [], 0
    for i, text in enumerate(texts):
        words = text.lower().split()
        own = list(words)
        for _ in range(max(1, int(len(words) * rng.uniform(0.002, 0.025)))):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        a, b = shingles(words), shingles(own)
        rows.append((2 * i, text, "en", "s", 1))
        if len(a & b) >= 0.8 * len(a | b):
            rows.append((2 * i + 1, " ".join(own), "en", "s", 1))
            copies += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, small).collect()}
    missed = sum(1 for r in rows if r[0] % 2 and r[0] in kept)
    assert copies > 150 and missed <= 0.1 * copies


def test_without_labels_only_texts_without_a_letter_go(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows = [(1, "plain words", None, "a", 1), (2, None, None, "a", 1), (3, "", None, "a", 1), (4, "1 2, 3", None, "a", 1), (5, "дом", None, None, None), (None, "é", None, "a", 1), (5, "дом", None, None, None)]
    for more in ([], [(held, "in the held-out fold", "en", "a", 1)]):
        out = corpus_pipeline.language(spark, spark.createDataFrame(rows + more, schema), small)
        want = [r for r in rows + more if r[1] and any(map(str.isalpha, r[1]))]
        assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_all_queries_are_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
