"""The corpus pipeline: stages of quarry.llm applied to documents, each to what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import mark, numbered, small_batches, stash, sweep, table, tokenizer_path
from quarry.llm.decontaminate import contamination
from quarry.llm.exact_dedup import deduplicate
from quarry.llm.language import UNKNOWN, has_letter, predict, train_language_model
from quarry.llm.packing import pack
from quarry.llm.simhash import keep_one

#: A text whose best language has less than this mean probability over its positions is rejected.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts in no language that the labelled rows show. Without labels to learn from, only
    texts without a letter are dropped. Null and empty texts have no letter; whole texts are judged, however long; each row by
    itself, so that repeats and ties play no part; other columns may have any names and nulls; an empty table stays empty."""
    small_batches(spark)
    model = train_language_model(docs)
    if model is None:
        return docs.where(F.pandas_udf(lambda s: s.map(has_letter), "boolean")(F.col("text")))
    found = docs.select(F.struct(*docs.columns).alias("row"), predict(model, F.col("text")).alias("found"))
    return found.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= LEAST_SCORE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: the longest original, then the smallest doc_id (nulls last), then the smallest hash of
    the whole row. Null texts count as empty and form one group with them; contents of any length are compared whole; rows
    that repeat in every column are copies like any other; an empty table stays empty."""
    small_batches(spark)
    rows = numbered(docs, "exact-rows", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64(*docs.columns).alias("tie")).alias("order"))
    found = deduplicate(rows.select("n", F.col("row.text").alias("text")), "n").where("group_size > 1").select(F.col("doc_id").alias("n"), "keep_id", "keep_chars")
    copies = stash(found.join(rows.select("n", "chars", "order"), "n"), "exact-copies")
    best = stash(copies.where("chars = keep_chars").groupBy("keep_id").agg(F.min(F.struct("order", "n"))["n"].alias("stays")), "exact-best")  # a table, so that a large group's rows can be split in the join
    gone = stash(copies.join(best, "keep_id").where("n <> stays").select("n"), "exact-gone")
    return rows.join(gone, "n", "left_anti").select("row.*")


#: Near-duplicates: shingles of five words; fingerprints of 256 bits that link at 48 differing bits (0.81 agree). A pair with a
#: resemblance of 0.8 is expected to differ in 39 of them: such a pair meets in some table with a probability of 0.95.
NEAR = {"width": 5, "seed": 42, "words": 4, "distance": 48, "sought": 39, "recall": 0.95}


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the smallest doc_id. Nulls, repeats, ties and long texts: see keep_one()."""
    small_batches(spark)
    return keep_one(docs, **NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words (or all words of a shorter item) of the benchmark. Null and empty texts have no
    words and stay; whole texts are searched; each row by itself, so that repeats and ties play no part; other columns may
    have any names and nulls; an empty table, or an empty benchmark, changes nothing."""
    small_batches(spark)
    found = contamination(docs, table(spark, sf_dir, "benchmark"), null_ids=True)
    return found.where(F.col("found.n_hit") == 0).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens. Null texts are empty: their one token is the end. Repeated rows and ids are packed
    each for itself; longer texts are cut and no token is lost; other columns are not read; an empty table gives no rows."""
    small_batches(spark)
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("packing", packing)]

#: No SQL: a trained network, XXH64 fingerprints and a tokenizer are among the stages. tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage wrote on its way, and its input, are deleted once its result is stored."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(spark, since, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
