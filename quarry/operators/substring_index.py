"""Substring search from a stored index: lists of texts by trigram are intersected, and what is left is verified on whole texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.retrieval import in_turn, keyword_totals, spread
from quarry.sources.store import scratch, stored

_PIECE = 1 << 20


def _codes(text: str) -> np.ndarray:
    """The distinct trigrams of code points, each as a number of 63 bits, ascending. A long text is taken by pieces that overlap."""
    out = []
    for i in range(0, max(1, len(text)), _PIECE):
        c = np.frombuffer(text[i : i + _PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out.append(np.unique(c[:-2] | c[1:-1] << 21 | c[2:] << 42))
    return out[0] if len(out) == 1 else np.unique(np.concatenate(out))


def trigrams(text: Column) -> Column:
    """Those of a column, as an array."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(_codes)

    return run(text)


def _postings(most: int):
    """Batches of (n, low) -> (shard, gram, texts). A task makes a shard of every ``most`` postings or so, named by its first text."""

    def shard(codes: list, rows: list) -> Iterator[pa.RecordBatch]:
        gram, n = np.concatenate(codes), np.repeat(np.array(rows, np.int64), [len(c) for c in codes])
        order = np.argsort(gram, kind="stable")
        gram, n = gram[order], n[order]
        starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if len(gram) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(gram)), pa.int32()), pa.array(n))
        whole = pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), rows[0], np.int64)), pa.array(gram[starts]), lists], ["shard", "gram", "texts"])
        for i in range(0, len(starts), 20_000):
            yield whole.slice(i, 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, rows, held = [], [], 0
        for batch in batches:
            for n, low in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes.append(_codes(low.as_py()))
                rows.append(n)
                held += len(codes[-1])
                if held >= most:
                    yield from shard(codes, rows)
                    codes, rows, held = [], [], 0
        if rows:
            yield from shard(codes, rows)

    return run


def _met(probes: dict[str, list[int]]):
    """The wanted lists of one shard -> (n, words): the texts that are in all lists of a word."""

    def run(own: pa.Table) -> pa.Table:
        lists = {g: t.values.to_numpy() for g, t in zip(own.column("gram").to_pylist(), own.column("texts"), strict=True)}
        words = defaultdict(list)
        for word, grams in probes.items():
            if all(g in lists for g in grams):
                first, *more = sorted((lists[g] for g in grams), key=len)
                for other in more:
                    first = np.intersect1d(first, other, assume_unique=True)
                for n in first.tolist():
                    words[n].append(word)
        return pa.table({"n": pa.array(list(words), pa.int64()), "words": pa.array(list(words.values()), pa.list_(pa.string()))})

    return run


@dataclass
class SubstringIndex:
    """Three tables in a folder: ``texts`` (n, low), ``postings`` (shard, gram, texts), in which a list has only texts of its shard, and
    ``counts`` (gram, texts)."""

    texts: DataFrame
    postings: DataFrame
    counts: DataFrame

    def candidates(self, words: DataFrame, lists: int = 4) -> DataFrame:
        """(n, words) of the texts that a bounded block of words (word), each of three characters or more, may stand in. Of each word
        its ``lists`` rarest trigrams are looked up; a word with a trigram that is nowhere has no candidates."""
        grams = words.select("word", trigrams(F.col("word")).alias("grams")).select("word", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
        known = grams.join(self.counts, "gram").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "gram"))).alias("found"))
        rarest = F.transform(F.slice("found", 1, lists), lambda x: x["gram"])
        probes = {r["word"]: r["grams"] for r in known.where(F.size("found") == F.col("n")).select("word", rarest.alias("grams")).collect()}
        wanted = self.postings.sparkSession.createDataFrame([(g,) for g in sorted({g for own in probes.values() for g in own})], "gram long")
        lists_of = self.postings.join(F.broadcast(wanted), "gram", "left_semi")  # at most ``lists`` a word of the block
        return lists_of.groupBy("shard").applyInArrow(_met(probes), "n long, words array<string>")

    def totals(self, queries: DataFrame, at_once: int = 10_000) -> DataFrame:
        """What keyword_totals() gives for the texts of the index: (query_id, relevant), how many texts hold each query's keyword, case aside.
        Null keywords, and keywords in no text, are left out; an empty one is in all texts. Keywords may repeat. Those of fewer than three
        characters have no trigram: they are searched in all texts, in one pass."""
        keys = queries.select("query_id", F.lower("keyword").alias("word")).where("word is not null")
        words = stored(keys.select("word").distinct())
        few, many = (words.where(c) for c in (F.length("word") < 3, F.length("word") >= 3))
        n = many.count()
        blocks = max(1, -(-2 * n // at_once)) if n > at_once else 1

        def one(block: int) -> DataFrame:
            met = stored(self.candidates(many.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == block)))  # of a known size
            held = self.texts.join(met, "n").select(F.explode(F.filter("words", lambda w: F.contains(F.col("low"), w))).alias("word"))
            return held.groupBy("word").agg(F.count("*").alias("relevant"))

        found = in_turn(words.sparkSession, one, blocks)
        if few.count():
            found = found.unionByName(keyword_totals(self.texts.withColumnRenamed("low", "text"), few.select(F.col("word").alias("query_id"), F.col("word").alias("keyword"))).withColumnRenamed("query_id", "word"))
        return keys.join(found, "word").select("query_id", "relevant")


def build(docs: DataFrame, folder: str | None = None, postings_a_shard: int = 2_000_000) -> SubstringIndex:
    """Indexes the texts of docs (text), each of any length; null ones are in no list. Texts are read once; nothing is shuffled but
    one number a trigram and shard. Other columns are not read; an empty table makes an empty index."""
    spark, at = docs.sparkSession, (folder or scratch(docs.sparkSession)).rstrip("/")
    low = spread(docs.where("text is not null").select("text")).select(F.monotonically_increasing_id().alias("n"), F.lower("text").alias("low"))
    write = lambda df, name: df.write.option("compression", "zstd").parquet(f"{at}/{name}")
    write(low, "texts")
    texts = spark.read.schema(_SCHEMAS["texts"]).parquet(f"{at}/texts")
    write(texts.mapInArrow(_postings(postings_a_shard), _SCHEMAS["postings"]), "postings")
    postings = spark.read.schema(_SCHEMAS["postings"]).parquet(f"{at}/postings")
    write(postings.groupBy("gram").agg(F.sum(F.size("texts")).alias("texts")), "counts")
    return load(spark, at)


_SCHEMAS = {"texts": "n long, low string", "postings": "shard long, gram long, texts array<long>", "counts": "gram long, texts long"}


def load(spark: SparkSession, folder: str) -> SubstringIndex:
    """An index that was built in this folder before."""
    return SubstringIndex(**{name: spark.read.schema(s).parquet(f"{folder.rstrip('/')}/{name}") for name, s in _SCHEMAS.items()})
