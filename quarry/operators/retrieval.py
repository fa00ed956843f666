"""Ranked retrieval: nearest neighbours, BM25, fusion, thresholds, reranking, version scopes.

Every result has query_id, id, score and rank (from 1), with a total order: score, then what the operator documents,
then id. Queries are a stated set; they go to the tasks in blocks of bounded size, against all rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import lower_words
from quarry.functions.vectors import sigmoid
from quarry.sources.store import stored
from quarry.workers import give_back

#: Query vectors (of up to 1024 dimensions) that one task holds at once: 64 MB.
QUERIES_AT_ONCE = 8192

#: Scores of a query and a row that a task computes at once: 2 MB, in a few copies.
SCORES_AT_ONCE = 1 << 18

#: Words that a task counts, or remembers, at once: some 15 MB.
WORDS_AT_ONCE = 100_000


def ranked(df: DataFrame, k: int, *order: Column, key: str = "query_id") -> DataFrame:
    """The first k rows of each query. Spark prunes to k rows before the shuffle."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def spread(df: DataFrame, bytes_a_core: int = 8 << 20) -> DataFrame:
    """Deals the rows of a small input out to all cores: one small file is one row group, whatever the splits. Larger inputs come
    in enough row groups and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * bytes_a_core else df


def in_turn(spark: SparkSession, one: Callable[[int], DataFrame | None], blocks: int) -> DataFrame | None:
    """The results of all blocks. Where there are several, each is stored before the next one is made, so that the driver holds what goes
    to the tasks (weights, vectors, words) of one block at a time."""
    out = []
    for b in range(blocks):
        df = one(b)
        if df is not None:
            out.append(df if blocks == 1 else stored(df))
    return functools.reduce(DataFrame.unionAll, out) if out else None


class _Best:
    """The k best (score, id) of each query so far, by score and then by id."""

    def __init__(self, ids: list, k: int):
        self.ids, self.k, self.n = ids, k, 0
        self.scores, self.rows = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)

    def room(self, n: int) -> None:
        """Places, up to k, for n rows that are then added for each of the queries."""
        more = min(self.k, self.scores.shape[1] + n) - self.scores.shape[1]
        if more > 0:
            self.scores = np.pad(self.scores, ((0, 0), (0, more)), constant_values=np.nan)
            self.rows = np.pad(self.rows, ((0, 0), (0, more)), constant_values=np.iinfo(np.int64).max)

    def add(self, scores: np.ndarray, rows: np.ndarray, at: int | None = None) -> None:
        """scores: (queries, rows), of all queries or, after ``room``, of those from place ``at`` on. Only what reaches a query's k best is
        sorted; NaN comes last."""
        if at is None:
            self.room(len(rows))
        at = at or 0
        own = slice(at, at + len(scores))
        q, r = np.nonzero(~(scores < self.scores[own, -1:]))
        q, first = np.concatenate((np.repeat(np.arange(len(scores)), self.scores.shape[1]), q)), len(scores) * self.scores.shape[1]
        s, i = np.concatenate((self.scores[own].ravel(), scores[q[first:], r])), np.concatenate((self.rows[own].ravel(), rows[r]))
        order = np.lexsort((i, -s, q))
        q = q[order]
        best = order[np.arange(len(q)) - np.searchsorted(q, q) < self.scores.shape[1]]
        self.scores[own], self.rows[own] = s[best].reshape(len(scores), -1), i[best].reshape(len(scores), -1)

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": np.repeat(self.ids, self.rows.shape[1]), "id": self.rows.ravel(), "score": self.scores.ravel()})


def _nearest(ids: list, matrix: np.ndarray, k: int, metric: str):
    """Batches of (id, embedding) -> the k best of each query in this task. Scores are computed for some queries and some rows at a time."""
    norms, squares = np.linalg.norm(matrix, axis=1), (matrix * matrix).sum(1)

    def scores(x: np.ndarray, own: slice) -> np.ndarray:
        if metric == "l2":
            return -(np.add.outer(squares[own], (x * x).sum(1)) - 2 * matrix[own] @ x.T)
        by = np.outer(norms[own], np.linalg.norm(x, axis=1))
        return np.divide(matrix[own] @ x.T, by, out=np.zeros_like(by), where=by > 0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(ids, k)
        for f in frames:
            f = f[f["embedding"].notna()]
            for start in range(0, len(f), 1024):
                part = f.iloc[start : start + 1024]
                x, rows = np.stack(part["embedding"].to_numpy()).astype(np.float64), part["id"].to_numpy(np.int64)
                best.room(len(rows))
                for at in range(0, len(ids), SCORES_AT_ONCE // 1024):
                    best.add(np.round(scores(x, slice(at, at + SCORES_AT_ONCE // 1024)), 12), rows, at)
        yield best.frame()
        give_back()

    return run


def knn(vectors: DataFrame, queries: DataFrame, k: int = 5, metric: str = "cosine", where: Column | None = None) -> DataFrame:
    """Exact k nearest neighbours. vectors: (id, embedding), queries: (query_id, embedding).

    A metadata filter goes before the ranking, so that it reaches the scan. Each task keeps k candidates of each
    query; only those are shuffled. score: cosine, or minus the squared distance. Null vectors are left out, in the tasks: a
    filter on vectors that a function makes would have them made twice. Queries
    are taken in blocks of about QUERIES_AT_ONCE, one after the other, so their number has no limit either: the results of
    several blocks are stored when this is called.
    """
    rows = (vectors if where is None else vectors.where(where)).select(F.col("id").cast("long"), "embedding")
    n = queries.count()
    blocks = max(1, -(-n // QUERIES_AT_ONCE))

    def one(block: int) -> DataFrame | None:
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        held = own.select(F.col("query_id").cast("long"), "embedding").where("embedding is not null").orderBy("query_id").toPandas()
        if not len(held):
            return None
        matrix = np.stack(held["embedding"].to_numpy()).astype(np.float64)
        found = rows.mapInPandas(_nearest(held["query_id"].tolist(), matrix, k, metric), "query_id long, id long, score double")
        return ranked(found, k, F.desc("score"), F.col("id"))

    out = in_turn(vectors.sparkSession, one, blocks)
    return rows.select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0) if out is None else out


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII white space, in UTF-8: what functions.text.lower_words gives."""
    return (text or "").lower().encode("utf-8", "replace").split()


class _Places(dict):
    """Where a word's count goes in a hashed vector. Remembers a bounded number of words."""

    def __init__(self, dimensions: int):
        super().__init__()
        self.dimensions = dimensions

    def __missing__(self, word: bytes) -> int:
        p = int(hashlib.md5(word).hexdigest()[:4], 16) % self.dimensions
        if len(self) < WORDS_AT_ONCE:
            self[word] = p
        return p


def hashed_embedding(text: Column, dimensions: int = 64) -> Column:
    """The default embedder: counts of lower-cased words by a hash of the word. Any other is a column function like this."""

    @F.pandas_udf("array<double>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = _Places(dimensions)
        for s in it:
            out = []
            for t in s:
                words = words_of(t)
                out.append(np.bincount(np.fromiter(map(places.__getitem__, words), np.int64, len(words)), minlength=dimensions).astype(np.float64))
            yield pd.Series(out)
        places.clear()
        give_back()

    return run(text)


def _term_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(text) -> (term, df), combined over a task as far as memory allows, and a row without a term: documents and words."""
    df, n, total = Counter(), 0, 0
    for f in frames:
        for text in f["text"]:
            words = words_of(text)
            n, total = n + 1, total + len(words)
            df.update(set(words))
            if len(df) > WORDS_AT_ONCE:
                yield pd.DataFrame({"term": list(df), "df": list(df.values()), "words": 0})
                df.clear()
    yield pd.DataFrame({"term": [*df, None], "df": [*df.values(), n], "words": [0] * len(df) + [total]})
    df.clear()
    give_back()


def _okapi(ids: list, place: dict[bytes, int], weights: np.ndarray, mean: float, k: int, k1: float, b: float):
    """Batches of (id, text) -> the k best of each query in this task. weights: (terms, queries), idf times how often the
    query has the term."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, rows, scores = _Best(ids, k), [], []
        none = np.zeros(len(ids))

        def pass_on() -> None:
            best.add(np.round(np.stack(scores, 1), 9), np.array(rows, np.int64))
            rows.clear()
            scores.clear()

        for f in frames:
            for i, text in zip(f["id"], f["text"], strict=True):
                words = words_of(text)
                tf = Counter([p for w in words if (p := place.get(w)) is not None])
                rows.append(i)
                if tf:
                    n = np.fromiter(tf.values(), np.float64, len(tf))
                    scores.append((n * (k1 + 1) / (n + k1 * (1 - b + b * len(words) / mean))) @ weights[np.fromiter(tf, np.int64, len(tf))])
                else:
                    scores.append(none)
                if len(rows) >= 1024:
                    pass_on()
        if rows:
            pass_on()
        yield best.frame()
        give_back()

    return run


#: Queries whose weights one task holds at once: a few MB.
TEXT_QUERIES_AT_ONCE = 256


def bm25(docs: DataFrame, queries: DataFrame, k: int = 5, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, where: Column | None = None, statistics_of_all: bool = False) -> DataFrame:
    """Okapi BM25. docs: (id, text), queries: (query_id, text). Adds ``normalised``: the score over the best one of the query
    (1 if that is not positive), rounded to 4 places.

    Terms are lower-cased white-space words; repeated query terms count again; negative idf become epsilon times the
    mean idf over all terms. Documents without a query term score 0 and still rank. ``where`` filters the documents, before
    the statistics or, with ``statistics_of_all``, after them.

    One pass counts in how many documents each term occurs, combined by task before the shuffle. A second one scores each
    document where it lies against a block of queries, and keeps k of each query and task: postings are never shuffled,
    and a frequent term costs no more than its occurrences. Queries of any number are taken in blocks.

    The statistics and each block's weights are computed when this is called, not when the result is read; the documents are read
    once for the statistics and once for each block of TEXT_QUERIES_AT_ONCE queries.
    """
    wanted = docs if where is None else docs.where(where)
    terms = spread((docs if statistics_of_all else wanted).select("text")).mapInPandas(_term_counts, "term binary, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")).persist()
    counted = terms.where("term is null").first()
    n, mean = (counted["df"], counted["words"] / max(1, counted["df"]) or 1.0) if counted else (0, 1.0)
    idf = terms.where("term is not null").withColumn("idf", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = (idf.agg(F.avg("idf")).first()[0] or 0.0) * epsilon
    n_queries = queries.count()
    blocks = max(1, -(-2 * n_queries // TEXT_QUERIES_AT_ONCE)) if n_queries > TEXT_QUERIES_AT_ONCE else 1

    def one(block: int) -> DataFrame | None:
        own = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).select(F.col("query_id").cast("long"), "text").orderBy("query_id").collect()
        if not own:
            return None
        place, weights = weights_of(own, idf, floor)
        scored = spread(wanted.where("id is not null").select(F.col("id").cast("long"), "text")).mapInPandas(_okapi([r["query_id"] for r in own], place, weights, mean, k, k1, b), "query_id long, id long, score double")
        return ranked(scored, k, F.desc("score"), F.col("id"))

    first = in_turn(docs.sparkSession, one, blocks)
    terms.unpersist()
    if first is None:
        return wanted.select(F.lit(0).cast("long").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"), F.lit(0.0).alias("normalised")).limit(0)
    return normalised(first)


def weights_of(queries: list, idf: DataFrame, floor: float) -> tuple[dict[bytes, int], np.ndarray]:
    """The words of a block of queries (query_id, text), and their weights, (words, queries). idf: (term, idf) of all words."""
    asked = [Counter(words_of(r["text"])) for r in queries]
    place = {w: i for i, w in enumerate(sorted({w for c in asked for w in c}))}
    known = idf.sparkSession.createDataFrame([(bytearray(w),) for w in place], "term binary")
    weights = np.zeros((max(1, len(place)), len(queries)))
    for r in idf.join(F.broadcast(known), "term").collect():  # at most the block's terms
        w = bytes(r["term"])
        for i, c in enumerate(asked):
            if w in c:
                weights[place[w], i] = c[w] * (floor if r["idf"] < 0 else r["idf"])
    return place, weights


def normalised(first: DataFrame) -> DataFrame:
    """Adds the score over the best one of the query."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return first.withColumn("normalised", F.round(F.col("score") / F.when(best > 0, best).otherwise(1.0), 4))


def fuse(dense: DataFrame, sparse: DataFrame, k: int = 5, alpha: str = "0.5") -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse over the candidates of either, a missing score being 0; rounded to 4 places, then sorted;
    ties keep the dense order, then the sparse one. Both have query_id, id, score, rank. Exact decimal arithmetic."""
    money = "decimal(12,4)"
    a = dense.select("query_id", "id", F.round("score", 4).cast(money).alias("dense"), F.col("rank").alias("dense_rank"))
    b = sparse.select("query_id", "id", F.col("normalised").cast(money).alias("sparse"), F.col("rank").alias("sparse_rank"))
    zero = F.lit(0).cast(money)
    w = F.lit(alpha).cast("decimal(4,2)")
    both = a.join(b, ["query_id", "id"], "full_outer").withColumn("score", F.round(w * F.coalesce("dense", zero) + (F.lit(1).cast("decimal(4,2)") - w) * F.coalesce("sparse", zero), 4).cast("double"))
    return ranked(both, k, F.desc("score"), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank"), F.col("id")).select("query_id", "id", "score", "rank")


def fuse_by_distance(dense: DataFrame, sparse: DataFrame, k: int = 5, alpha: float = 0.5) -> DataFrame:
    """The other fusion: dense scores are 1 - d / (largest d among the query's candidates), d being 1 - cosine; when that is 0, the
    score is 0. Sorted by the unrounded score, then id."""
    d = 1 - F.col("score")
    most = F.max(d).over(Window.partitionBy("query_id"))
    a = dense.select("query_id", "id", F.coalesce(1 - F.try_divide(d, most), F.lit(0.0)).alias("dense"))
    b = sparse.select("query_id", "id", F.col("normalised").alias("sparse"))
    both = a.join(b, ["query_id", "id"], "full_outer").withColumn("score", F.round(alpha * F.coalesce("dense", F.lit(0.0)) + (1 - alpha) * F.coalesce("sparse", F.lit(0.0)), 9))
    return ranked(both, k, F.desc("score"), F.col("id")).select("query_id", "id", "score", "rank")


def above(results: DataFrame, least: float = 0.2, k: int = 5) -> DataFrame:
    """Results with at least this score; queries that have none keep their first k."""
    passes = F.col("score") >= least
    some = F.max(passes).over(Window.partitionBy("query_id"))
    kept = results.withColumn("some", some).where(F.when(F.col("some"), passes).otherwise(F.col("rank") <= k)).drop("some")
    return ranked(kept.withColumnRenamed("rank", "was"), 1 << 30, F.col("was")).drop("was")


def _holding(words: list[str]):
    """Batches of (low) -> (word, relevant): how many of the texts hold each word as a substring; every text is read once for all words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        search, n, texts = ahocorasick.Automaton(), Counter(), 0
        for w in words:
            if w:
                search.add_word(w, w)
        search.make_automaton()
        for f in frames:
            for text in f["low"]:
                texts += 1
                if len(search):
                    n.update({w for _, w in search.iter(text)})
        if "" in words:
            n[""] = texts  # in every text
        yield pd.DataFrame({"word": pd.Series(list(n), dtype=object), "relevant": pd.Series(list(n.values()), dtype="int64")})

    return run


def keyword_totals(docs: DataFrame, queries: DataFrame, at_once: int = 10_000) -> DataFrame:
    """(query_id, relevant): how many documents hold each query's keyword as a substring, case aside; keywords in none are left out. Each block of
    at most about ``at_once`` keywords goes to the tasks as one automaton and is one pass over the documents; a task passes on one
    number for each keyword that it met."""
    keys = queries.select("query_id", F.lower("keyword").alias("word")).where("word is not null")
    n = keys.select("word").distinct().count()
    blocks = max(1, -(-2 * n // at_once)) if n > at_once else 1
    low = spread(docs.where("text is not null").select("text")).select(F.lower("text").alias("low"))

    def one(block: int) -> DataFrame:
        own = keys.select("word").distinct().where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == block)
        held = low.mapInPandas(_holding([r["word"] for r in own.collect()]), "word string, relevant long")
        return held.groupBy("word").agg(F.sum("relevant").alias("relevant"))

    return keys.join(in_turn(docs.sparkSession, one, blocks), "word").select("query_id", "relevant")


def lexical_score(query: Column, text: Column) -> Column:
    """The default reranking score before the sigmoid: 8 times the share of distinct query words in the text, less 4."""
    q = F.array_distinct(lower_words(query))
    share = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, lower_words(text))) / F.size(q))
    return 8 * share - 4


def rerank(results: DataFrame, k: int = 5, scorer: Callable[[Column, Column], Column] = lexical_score) -> DataFrame:
    """Orders results (query_id, id, rank, query, text) by a pair scorer through a sigmoid, rounded to 4 places; ties keep their rank."""
    scored = results.withColumn("score", F.round(sigmoid(scorer(F.col("query"), F.col("text"))), 4)).withColumnRenamed("rank", "was")
    return ranked(scored, k, F.desc("score"), F.col("was")).drop("was")


def with_fallback(scoped: DataFrame, queries: DataFrame, unscoped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scoped results; queries without any get unscoped ones. Adds ``fallback``."""
    left = queries.join(scoped.select("query_id").distinct(), "query_id", "left_anti")
    return scoped.withColumn("fallback", F.lit(False)).unionByName(unscoped(left).withColumn("fallback", F.lit(True)))


def version_scope(version: Column, date: Column, target: str | None, mode: str = "exact") -> Column:
    """The filter of a version scope: exact, history (dated up to the target's date) or unfiltered."""
    from quarry.functions.versions import version_date

    if target is None or mode == "unfiltered":
        return F.lit(True)
    return version == target if mode == "exact" else date <= version_date(F.lit(target))
