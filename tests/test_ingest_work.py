"""Work that ingestion does once."""

from pyspark.sql import functions as F

from quarry.functions.text import chunk_markdown
from quarry.operators.retrieval import hashed_embedding
from quarry.sources import readers
from quarry.sources.store import RECORDS, VECTORS, Store, ingest


def test_long_paragraphs_are_packed_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("t")).select(chunk_markdown(F.col("t")).alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(r"(?<=[.!?])\s+") == 1


def test_keys_are_taken_without_the_cache_of_vectors(spark, tmp_path, monkeypatch):
    records, vectors = Store(spark, f"{tmp_path}/r", RECORDS, "chunk_id", 4), Store(spark, f"{tmp_path}/v", VECTORS, "chunk_id", 4)
    given, change = [], vectors.change
    monkeypatch.setattr(vectors, "change", lambda upserts, gone=None, keys=None: given.append(keys) or change(upserts, gone, keys))
    text = "A paragraph that is long enough. "
    files = spark.createDataFrame([(f"doc{i} 3.5.{i % 2}.md", text * (i + 1)) for i in range(4)], "source_file string, text string")
    ingest(readers.markdown_chunks(files), records, vectors, hashed_embedding)
    ingest(readers.markdown_chunks(files.where("source_file not like 'doc3%'").withColumn("text", F.concat("text", F.lit("More of it.")))), records, vectors, hashed_embedding)
    assert len(given) == 2 and all(k is not None and "Join LeftSemi" not in k._jdf.queryExecution().analyzed().toString() for k in given)
    assert {r.source_file for r in vectors.read().collect()} == {f"doc{i} 3.5.{i % 2}.md" for i in range(3)} and vectors.read().where("text not like '%More of it.'").count() == 0


def test_large_changes_shuffle_keys_alone(spark, tmp_path, monkeypatch):
    """rows that stay are neither shuffled to lose others nor dealt out to be written."""
    schema = "id string, n int, text string"
    rows = [(f"k{i}", i, "t" * (i % 7)) for i in range(3000)]
    plans, write = [], Store._write
    monkeypatch.setattr(Store, "_write", lambda self, df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(self, df, *a))
    got = {}
    for dealt in (True, False):
        store = Store(spark, f"{tmp_path}/{dealt}", schema, "id", 4)
        for part, gone in ((rows[:2000], []), ([(k, -n, "new") for k, n, _ in rows[1000:1300:3]] + rows[2000:], ["k0", "k7", "none", "k2999"]), ([("k5", 5, None)], ["k1999"])):
            store.change(spark.createDataFrame(part, schema).repartition(3), spark.createDataFrame([(g,) for g in gone], "id string") if gone else None, dealt=dealt)
        got[dealt] = sorted(map(tuple, store.read().collect()), key=repr)
    want = {r[0]: r for r in rows[:2000]} | {k: (k, -n, "new") for k, n, _ in rows[1000:1300:3]} | {r[0]: r for r in rows[2000:]}
    for k in ("k0", "k7", "k1999"):
        want.pop(k)
    want["k5"] = ("k5", 5, None)
    assert got[True] == got[False] == sorted(want.values(), key=repr)
    assert all("LeftAnti" not in p for p in plans[4:]) and "LeftAnti" in plans[1] and len(plans) == 6


def test_a_batch_keeps_no_texts_in_memory(spark, tmp_path, monkeypatch):
    """texts that are cut lie in one folder, compressed, until the batch ends."""
    from quarry.streaming import ingest as stream

    folders = []
    monkeypatch.setattr(stream, "scratch", lambda s: folders.append(f"{tmp_path}/cut{len(folders)}") or folders[-1])
    cached, persist = [], type(spark.range(1)).persist
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda self, *a: cached.append(self.columns) or persist(self, *a))
    stores = Store(spark, f"{tmp_path}/s", stream.SEEN, "source_file", 4), Store(spark, f"{tmp_path}/r", RECORDS, "chunk_id", 4), Store(spark, f"{tmp_path}/v", VECTORS, "chunk_id", 4)
    text = "A paragraph that is long enough. "
    files = spark.createDataFrame([(f"doc{i} 3.5.{i % 2}.md", text * (i + 1), "") for i in range(4)], "source_file string, text string, path string").withColumn("arrived", F.lit(0).cast("timestamp"))
    stream.apply(files, 0, *stores, hashed_embedding)
    stream.apply(files.withColumn("text", F.concat("text", F.lit("More."))), 1, *stores, hashed_embedding)
    assert len(folders) == 2 and not any(tmp_path.glob("cut*"))
    assert cached and not any({"text", "texts"} & set(c) for c in cached)
    assert stores[2].read().where("text like '%More.'").count() == 4
