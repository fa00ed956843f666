"""Relevance, retrieval metrics, answer metrics, latency and category reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.classify import CATEGORIES, classify_failure, classify_query
from quarry.functions.text import contains_any, content_words, jaccard, long_words, share_contained
from quarry.operators.selection import percentiles

# Phrases and stop words (fixed values).
REFUSALS = ("don't have", "not have", "not enough", "don't know", "could not find", "no information")
ANSWER_STOP = ("based", "context", "synthesized", "answer", "movie", "film", "features", "members", "document", "provided", "provides")
TRUTH_STOP = ("directed", "director", "features", "released", "movie", "film", "short", "genre", "cast", "written")


def is_relevant(doc_id: Column, title: Column, text: Column, truth: Column, least: float = 0.4) -> Column:
    """Whether a document fits a ground truth: equal ids (also without ``movie_``), a title equal to, in or around it, a text in or
    around it, or a Jaccard above ``least`` of words longer than three. An empty truth fits nothing; an empty text
    fits any other."""
    low = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    i, h, t, g = low(doc_id), low(title), low(text), low(truth)
    by_id = (i == g) | (F.replace(i, F.lit("movie_"), F.lit("")) == g)
    by_title = (h != "") & (F.contains(g, h) | F.contains(h, g))
    by_text = F.contains(t, g) | F.contains(g, t)
    return (g != "") & (by_id | by_title | by_text | (jaccard(long_words(text), long_words(truth.cast("string"))) > least))


def tier1(results: DataFrame, truths: DataFrame, k: int = 5) -> DataFrame:
    """hit, precision (over k always), recall (1 without truths) and mrr of each query.

    results: (query_id, rank, id, title, text, similarity); truths: (query_id, truth). They meet on the query alone."""
    top = results.where(F.col("rank") <= k)
    pairs = top.join(truths, "query_id", "left").withColumn("fits", F.coalesce(is_relevant(F.col("id"), F.col("title"), F.col("text"), F.col("truth")), F.lit(False)))
    docs = pairs.groupBy("query_id", "rank").agg(F.max("fits").alias("fits"), F.first("similarity").alias("similarity"))
    by_doc = docs.groupBy("query_id").agg(
        F.count_if("fits").alias("relevant"), F.coalesce(1 / F.min(F.when(F.col("fits"), F.col("rank"))), F.lit(0.0)).alias("mrr"), F.round(F.avg("similarity"), 4).alias("avg_similarity")
    )
    by_truth = pairs.where("fits").groupBy("query_id").agg(F.countDistinct("truth").alias("met"))
    known = truths.groupBy("query_id").agg(F.countDistinct("truth").alias("truths"))
    out = by_doc.join(by_truth, "query_id", "left").join(known, "query_id", "left")
    return out.select(
        "query_id", (F.col("relevant") > 0).alias("hit"), (F.col("relevant") / k).alias("precision"),
        F.when(F.coalesce("truths", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("met", F.lit(0)) / F.col("truths")).alias("recall"), "mrr", "avg_similarity",
    )


def keyword_metrics(results: DataFrame, totals: DataFrame, k: int = 5) -> DataFrame:
    """Keyword hit, precision (over what was returned, at most k), recall (over at least one relevant document) and reciprocal rank.

    results: (query_id, rank, document, keyword); totals: (query_id, relevant). An empty keyword is in every document."""
    has = F.contains(F.lower("document"), F.lower("keyword"))
    per = results.where(F.col("rank") <= k).withColumn("has", has).groupBy("query_id").agg(
        F.max("has").alias("hit"), F.try_divide(F.count_if("has"), F.least(F.lit(k), F.count("*"))).alias("precision"), F.count_if("has").alias("n"), F.coalesce(1 / F.min(F.when(F.col("has"), F.col("rank"))), F.lit(0.0)).alias("mrr")
    )
    return per.join(totals, "query_id", "left").select("query_id", "hit", "precision", (F.col("n") / F.greatest(F.coalesce("relevant", F.lit(0)), F.lit(1))).alias("recall"), "mrr")


def mean(column: str) -> Column:
    """The mean of a metric between 0 and 1, or of a flag, at 4 places: of millionths, in whole numbers, so that no order of summing
    and no way of rounding changes it."""
    millionths = F.sum(F.round(F.col(column).cast("double") * 1_000_000).cast("long"))
    return (F.floor((2 * millionths + 100 * F.count(column)) / (200 * F.count(column))) / 10_000).alias(column)


def average_precision(flags: DataFrame) -> DataFrame:
    """(query_id, ap) from (query_id, rank, fits); 0 without a relevant result."""
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = flags.withColumn("p", F.count_if("fits").over(running) / F.col("rank"))
    return at.groupBy("query_id").agg(F.coalesce(F.avg(F.when(F.col("fits"), F.col("p"))), F.lit(0.0)).alias("ap"))


def robustness(a: Column, b: Column) -> Column:
    """Jaccard of the retrieved ids of a query and of its perturbed form; 1 when both are empty."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(jaccard(F.array_distinct(a), F.array_distinct(b)))


def faithfulness(answer: Column, context: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(contains_any(low, REFUSALS), 1.0).otherwise(share_contained(content_words(answer, ANSWER_STOP), F.lower(F.coalesce(context, F.lit("")))))


def context_recall(truth: Column, context: Column) -> Column:
    return share_contained(content_words(truth, TRUTH_STOP), F.lower(F.coalesce(context, F.lit(""))))


def noise_sensitivity(answer: Column, query: Column, relevant: Column, noise: Column) -> Column:
    """Share of distinct answer words that only noise documents have. relevant and noise are arrays of texts; 0 if either is empty."""
    misleading = F.array_except(content_words(F.array_join(noise, " ")), F.concat(content_words(F.array_join(relevant, " ")), content_words(query)))
    words = content_words(answer)
    none = (F.size(noise) == 0) | (F.size(relevant) == 0) | (F.size(misleading) == 0) | (F.size(words) == 0)
    return F.when(none, 0.0).otherwise(F.size(F.array_intersect(words, misleading)) / F.size(words))


def blend(heuristic: Column, judged: Column | None = None) -> Column:
    """Half heuristic, half judged where a judge said something; rounded to 4 places, half up, as decimals."""
    both = heuristic if judged is None else F.coalesce(0.5 * judged + 0.5 * heuristic, heuristic)
    return F.round(both.cast("decimal(12,8)"), 4).cast("double")


def latency(column: str, *groups: str):
    """p50, p95, p99 (linear interpolation, by selection), mean, min, max and count of a column; zeros for nothing."""

    def run(df: DataFrame) -> DataFrame:
        p = percentiles(df, column, groups, (0.5, 0.95, 0.99)).drop("n").toDF(*(f"_{g}" for g in groups), "p50", "p95", "p99")
        rest = df.groupBy(*groups).agg(F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"), F.count(column).alias("n"))
        same = F.lit(True)
        for g in groups:
            same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
        return rest.join(p, same).select(*groups, *(F.coalesce(F.round(c, 3), F.lit(0.0)).alias(c) for c in ("p50", "p95", "p99", "mean", "min", "max")), "n")

    return run


def leakage_rate(flags: DataFrame) -> DataFrame:
    """One row: total, leaks, rate (0 for nothing, 4 places) from (query_id, leak)."""
    return flags.agg(F.count("*").alias("total"), F.count_if("leak").alias("leaks"), F.coalesce(F.round(F.avg(F.col("leak").cast("double")), 4), F.lit(0.0)).alias("leakage_rate"))


def with_query_text(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Results (query_id, query, ...) whose text is null or empty take that of the query set (query_id, query); else it is empty."""
    known = queries.select("query_id", F.col("query").alias("_text"))
    text = F.coalesce(F.when(F.col("query") != "", F.col("query")), "_text", F.lit(""))
    return results.join(known, "query_id", "left").withColumn("query", text).drop("_text")


def category_metrics(facts: DataFrame) -> DataFrame:
    """One row for each query category that occurs. facts: (query, retrieved_chunks, temporal_leak, retrieval_latency_ms)."""
    good = (F.col("retrieved_chunks") > 0) & ~F.col("temporal_leak")
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    classed = facts.withColumn("category", classify_query(F.col("query")))
    p = percentiles(classed, "retrieval_latency_ms", ["category"], (0.5, 0.95)).select(F.col("category").alias("_category"), F.round("p0", 1).alias("p50_latency_ms"), F.round("p1", 1).alias("p95_latency_ms"))
    rest = classed.groupBy("category").agg(
        F.count("*").alias("number_of_queries"), F.count_if(good).alias("successful_retrievals"), F.round(100 * F.avg(good.cast("double")), 1).alias("retrieval_accuracy"),
        F.round(100 * F.avg(F.col("temporal_leak").cast("double")), 1).alias("temporal_leakage_rate"), F.round(F.avg("retrieval_latency_ms"), 1).alias("average_latency_ms"), F.round(F.avg("retrieved_chunks"), 1).alias("average_retrieved_chunks"),
    )
    return rest.join(p, F.col("category") == F.col("_category")).drop("_category").orderBy(F.desc("number_of_queries"), order)


def issues(facts: DataFrame, k: int = 5) -> DataFrame:
    """Facts that pass the issue gate (no chunk, a leak, or fewer than k chunks), with failure_category and notes."""
    gate = (F.col("retrieved_chunks") == 0) | F.col("temporal_leak") | (F.col("retrieved_chunks") < k)
    found = classify_failure(F.col("query"), F.col("expected_version"), F.col("retrieved_version"), F.col("retrieved_chunks"), F.col("temporal_leak"), threshold=k)
    return facts.where(gate).withColumn("f", found).select(*facts.columns, "f.failure_category", "f.notes")


def shares(df: DataFrame, column: str) -> DataFrame:
    """(column, n, share in percent with 1 place), the largest first. The total is a window over the few groups."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1)).orderBy(F.desc("share"), column)
