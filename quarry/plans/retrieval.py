"""Retrieval queries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import jaccard, long_words, typos
from quarry.functions.vectors import cosine
from quarry.operators import answers as A
from quarry.operators import relevance as M
from quarry.operators import retrieval as R
from quarry.operators import embeddings, ranker, substring_index, text_index, vector_index
from quarry.operators.models import timed_knn
from quarry.operators.set_join import relevant_documents
from quarry.sources.store import scratch, stored
from quarry.plans.tables import CAL_SQL, CONTENT, WORDS, answer_sql, any_sql, asked, bm25_sql, dense_sql, docs, fuse_sql, less_sql, query_vectors, share_sql, source_version, table, typos_sql, vectors

ROW = ("query_id", "id", "score", "rank")


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("score", 4).alias("score"), "rank")


def vector_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.knn(vectors(spark, d), query_vectors(spark, d), 5))


def vector_topk_l2(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.knn(vectors(spark, d), query_vectors(spark, d), 5, "l2").withColumn("score", -F.col("score")))


def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.knn(vectors(spark, d), query_vectors(spark, d), 5, where=F.col("label") == 3))


def knn_hit_precision_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Relevance is an equal label; the query's own vector is left to be found like any other."""
    v, q = vectors(spark, d), query_vectors(spark, d)
    found = R.knn(v, q, 5).join(v.select("id", "label"), "id").join(q.select("query_id", "query_label"), "query_id")
    fits = F.col("label") == F.col("query_label")
    per = found.groupBy("query_id", "query_label").agg(F.count_if(fits).alias("n"), F.coalesce(F.round(1 / F.min(F.when(fits, F.col("rank"))), 6), F.lit(0.0)).alias("mrr"))
    sizes = v.groupBy(F.col("label").alias("query_label")).agg(F.count("*").alias("relevant"))
    return per.join(sizes, "query_label").select("query_id", (F.col("n") > 0).alias("hit"), (F.col("n") / 5).alias("precision"), F.round(F.col("n") / F.col("relevant"), 6).alias("recall"), "mrr")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(docs(spark, d), asked(spark, d), 5).select("query_id", "id", "rank", F.col("normalised").alias("score"))


def bm25_topk_source(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25(docs(spark, d), asked(spark, d), 5, where=F.col("source") == "src0", statistics_of_all=True).select("query_id", "id", "rank", F.col("normalised").alias("score"))


def _sides(spark: SparkSession, d: str, pool: int, queries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    embedded = R.spread(docs(spark, d).select("id", "text")).select("id", R.hashed_embedding(F.col("text")).alias("embedding"))
    queries = asked(spark, d) if queries is None else queries
    dense = R.knn(embedded, queries.select("query_id", R.hashed_embedding(F.col("text")).alias("embedding")), pool)
    return dense, R.bm25(docs(spark, d), queries, pool)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_sides(spark, d, 5)[0])


def timed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same, stage by stage with their times, of which only that they were taken is shown."""
    embedded = R.spread(docs(spark, d).select("id", "text")).select("id", R.hashed_embedding(F.col("text")).alias("embedding"))
    found, ms = timed_knn(asked(spark, d), embedded, R.hashed_embedding, 5)
    stages = ", ".join(sorted(k for k, v in ms.items() if v > 0))
    return _shown(found).withColumn("timed", F.lit(stages))


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse(*_sides(spark, d, 15), 5, "0.5")


def hybrid_distance_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.fuse_by_distance(*_sides(spark, d, 20), 5, 0.5)


def threshold_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.above(R.fuse(*_sides(spark, d, 60), 20, "0.3"), 0.2, 5).select(*ROW)


def _with_texts(spark: SparkSession, d: str, results: DataFrame) -> DataFrame:
    queries = asked(spark, d).select("query_id", F.col("text").alias("query"))
    return results.select("query_id", "id", "rank").join(docs(spark, d).select("id", "text"), "id").join(queries, "query_id")


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(_with_texts(spark, d, R.bm25(docs(spark, d), asked(spark, d), 20)), 5).select(*ROW)


def hybrid_rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(_with_texts(spark, d, R.fuse(*_sides(spark, d, 60), 20, "0.5")), 5).select(*ROW)


def threshold_rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.rerank(_with_texts(spark, d, R.above(R.fuse(*_sides(spark, d, 60), 20, "0.3"), 0.2, 5)), 5).select(*ROW)


def version_fallback_topk(spark: SparkSession, d: str) -> DataFrame:
    """Each query in the scope of one version, first exactly, then, where its documents hold no query word, without a scope."""
    documents = docs(spark, d).withColumn("version", source_version())
    queries = asked(spark, d)
    scoped = R.bm25(documents, queries, 5, where=R.version_scope(F.col("version"), F.lit(None).cast("date"), "v3.5.4")).where("score > 0")
    out = R.with_fallback(scoped, queries, lambda left: R.bm25(documents, left, 5))
    return out.select("query_id", "id", "rank", F.col("normalised").alias("score"), "fallback")


def first_queries(spark: SparkSession, d: str) -> DataFrame:
    """What the first twenty of the queries, by id, are given to answer from: three documents of their version, else of any."""
    documents = docs(spark, d).withColumn("version", source_version())
    queries = asked(spark, d).orderBy("query_id").limit(20)
    scoped = R.bm25(documents, queries, 3, where=R.version_scope(F.col("version"), F.lit(None).cast("date"), "v3.5.4")).where("score > 0")
    return R.with_fallback(scoped, queries, lambda left: R.bm25(documents, left, 3)).select("query_id", "id", "rank", "fallback")


def jaccard_relevance(spark: SparkSession, d: str) -> DataFrame:
    """Whether each of a query's first five documents fits the query's text."""
    found = _with_texts(spark, d, R.bm25(docs(spark, d), asked(spark, d), 5))
    return found.select("query_id", "id", "rank", M.is_relevant(F.col("id"), F.lit(""), F.col("text"), F.col("query")).alias("fits"))


def _tier1(spark: SparkSession, d: str, results: DataFrame, similarity: str = "score") -> DataFrame:
    found = _with_texts(spark, d, results).join(results.select("query_id", "id", F.col(similarity).alias("similarity")), ["query_id", "id"])
    return M.tier1(found.withColumn("title", F.lit("")), asked(spark, d).select("query_id", F.col("text").alias("truth")))


def tier1_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _tier1(spark, d, R.bm25(docs(spark, d), asked(spark, d), 5), "normalised")


def _runs(spark: SparkSession, d: str, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first five of four pipelines over a set of queries (model, query_id, id, score, rank), and the texts (id, text) of all candidates. One dense
    pass and one BM25 pass; candidates, their texts and the results are stored, so that no plan nests them."""
    dense, sparse = map(stored, _sides(spark, d, 60, queries))
    ids = dense.select("id").union(sparse.select("id")).distinct()
    texts = stored(docs(spark, d).select("id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "id"))
    first = lambda df, n=15: df.where(F.col("rank") <= n)
    wide = stored(R.fuse(dense, sparse, 20, "0.5"))
    reranked = R.rerank(wide.select("query_id", "id", "rank").join(texts, "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id"), 5)
    runs = {"Vector": first(dense, 5), "BM25": first(sparse, 5).withColumn("score", F.col("normalised")), "Hybrid": R.fuse(first(dense), first(sparse), 5, "0.5"), "Hybrid+Rerank": reranked}
    parts = [df.select(F.lit(name).alias("model"), *ROW) for name, df in runs.items()]
    return stored(functools.reduce(DataFrame.unionAll, parts)), texts


def tier1_by_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Means of the metrics over all queries of each pipeline."""
    queries = asked(spark, d)
    runs, texts = _runs(spark, d, queries)
    # a run's query: the metrics are of each of them
    named = runs.select("model", F.struct("model", "query_id").alias("query_id"), "id", "rank", F.col("score").alias("similarity"))
    found = named.join(texts, "id").join(queries.select(F.col("query_id").alias("asked"), F.col("text").alias("query")), F.col("query_id.query_id") == F.col("asked")).withColumn("title", F.lit(""))
    truths = found.select("query_id", F.col("query").alias("truth")).distinct()
    return M.tier1(found, truths).select(F.col("query_id.model").alias("model"), "hit", "precision", "recall", "mrr").groupBy("model").agg(*map(M.mean, ("hit", "precision", "recall", "mrr")))


def tier2_by_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Means of the six answer metrics over all queries of each pipeline. A query is its own ground truth; answers are extracted. Queries
    and their perturbed forms are one set: even and odd ids."""
    queries, key = asked(spark, d), ["model", "query_id"]
    bent = queries.select("query_id", typos(F.col("text"), F.col("query_id")).alias("text"))
    both = queries.select((2 * F.col("query_id")).alias("query_id"), "text").unionAll(bent.select((2 * F.col("query_id") + 1).alias("query_id"), "text"))
    runs, texts_of = _runs(spark, d, stored(both))
    odd = F.pmod("query_id", F.lit(2)) == 1
    own = runs.withColumn("odd", odd).withColumn("query_id", F.floor(F.col("query_id") / 2))
    found = own.where("not odd").join(texts_of, "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    found = stored(found.withColumn("fits", M.is_relevant(F.col("id"), F.lit(""), F.col("text"), F.col("query"))))
    per = found.groupBy(*key).agg(F.first("query").alias("query"), F.collect_list(F.struct("rank", "text", "fits")).alias("docs"), F.collect_set("id").alias("ids"))
    per = stored(per.withColumn("docs", F.array_sort("docs")).withColumn("answer", A.answer(F.col("query"), F.col("docs"))))
    texts = lambda keep: F.transform(F.filter("docs", keep), lambda x: x["text"])
    context = F.array_join(texts(lambda x: F.lit(True)), " ")
    running = Window.partitionBy(*key).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = found.withColumn("p", F.count_if("fits").over(running) / F.col("rank")).groupBy(*key).agg(F.coalesce(F.avg(F.when(F.col("fits"), F.col("p"))), F.lit(0.0)).alias("context_precision"))
    moved = own.where("odd").groupBy(*key).agg(F.collect_set("id").alias("bent"))
    every = per.join(at, key).join(moved, key, "left").select(
        "model", M.faithfulness(F.col("answer"), context).alias("faithfulness"), cosine(R.hashed_embedding(F.col("query")), R.hashed_embedding(F.col("answer"))).alias("answer_relevancy"), "context_precision",
        M.context_recall(F.col("query"), context).alias("context_recall"), M.noise_sensitivity(F.col("answer"), F.col("query"), texts(lambda x: x["fits"]), texts(lambda x: ~x["fits"])).alias("noise_sensitivity"),
        M.robustness(F.col("ids"), F.coalesce("bent", F.array().cast("array<bigint>"))).alias("robustness"),
    )
    return every.groupBy("model").agg(*map(M.mean, TIER2))


TIER2 = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "noise_sensitivity", "robustness")


def _longest() -> Column:
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    return F.get(F.transform(F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))), lambda x: x["w"]), F.lit(0))


def keyword_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The keyword is the query's longest word (the first of equally long ones)."""
    queries = asked(spark, d).withColumn("keyword", _longest())
    found = R.bm25(docs(spark, d), queries, 5).join(docs(spark, d).select("id", F.coalesce("text", F.lit("")).alias("document")), "id").join(queries.select("query_id", "keyword"), "query_id")
    out = M.keyword_metrics(found, R.keyword_totals(docs(spark, d), queries), 5)
    return out.select("query_id", "hit", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr")))


def keyword_index_totals(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each query's longest word, and its first two characters, by the index of trigrams."""
    index = substring_index.build(docs(spark, d))
    both = [asked(spark, d).select(F.struct("query_id", F.lit(part).alias("part")).alias("query_id"), k.alias("keyword")) for part, k in (("word", _longest()), ("start", F.substring(_longest(), 1, 2)))]
    return index.totals(both[0].unionAll(both[1])).select("query_id.query_id", "query_id.part", "relevant")


def context_precision_ap(spark: SparkSession, d: str) -> DataFrame:
    v, q = vectors(spark, d), query_vectors(spark, d)
    found = R.knn(v, q, 10).join(v.select("id", "label"), "id").join(q.select("query_id", "query_label"), "query_id")
    return M.average_precision(found.select("query_id", "rank", (F.col("label") == F.col("query_label")).alias("fits"))).select("query_id", F.round("ap", 6).alias("ap"))


def robustness(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard of what a query and its perturbed form retrieve."""
    queries = asked(spark, d)
    ids = lambda q: R.bm25(docs(spark, d), q, 5).groupBy("query_id").agg(F.collect_set("id").alias("ids"))
    bent = queries.select("query_id", typos(F.col("text"), F.col("query_id")).alias("text"))
    a, b = ids(queries), ids(bent).withColumnRenamed("ids", "bent")
    return a.join(b, "query_id").select("query_id", F.round(M.robustness(F.col("ids"), F.col("bent")), 4).alias("robustness"))


def keyword_by_method(spark: SparkSession, d: str) -> DataFrame:
    """Keyword metrics of each method, averaged over all queries."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    queries = asked(spark, d).withColumn("keyword", F.get(words, F.lit(0)))
    totals = R.keyword_totals(docs(spark, d), queries).select(F.col("query_id").alias("asked"), "relevant")
    runs, texts = _runs(spark, d, asked(spark, d))
    named = runs.select(F.struct("model", "query_id").alias("query_id"), "id", "rank")
    found = named.join(texts.withColumnRenamed("text", "document"), "id").join(queries.select(F.col("query_id").alias("asked"), "keyword"), F.col("query_id.query_id") == F.col("asked"))
    relevant = found.select("query_id", "asked").distinct().join(totals, "asked").select("query_id", "relevant")
    per = M.keyword_metrics(found.drop("asked"), relevant, 5).withColumn("method", F.col("query_id.model"))
    return per.groupBy("method").agg(*map(M.mean, ("hit", "precision", "recall", "mrr")))


def corpus_relevance(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of the whole corpus fit each query by their words, a query being every document whose id is divisible by 20."""
    rows = docs(spark, d).select("id", long_words(F.col("text")).alias("words"))
    return relevant_documents(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows)


def corpus_recall(spark: SparkSession, d: str) -> DataFrame:
    """Of the documents of the whole corpus that fit each query, the share among its first five by BM25; 1 where none fits."""
    queries = asked(spark, d)
    words = lambda df, key: df.select(key, long_words(F.col("text")).alias("words"))
    every = relevant_documents(words(queries, "query_id"), words(docs(spark, d), "id"), 0.2)
    found = _with_texts(spark, d, R.bm25(docs(spark, d), queries, 5)).select("query_id", (jaccard(long_words(F.col("text")), long_words(F.col("query"))) > 0.2).alias("fits"))
    hits = found.groupBy("query_id").agg(F.count_if("fits").alias("found"))
    share = F.when(F.col("relevant") == 0, 1.0).otherwise(F.coalesce("found", F.lit(0)) / F.col("relevant"))
    return every.join(hits, "query_id", "left").select("query_id", "relevant", F.round(share, 6).alias("recall"))


def _ranked_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, ranker.PairRanker]:
    """Candidates of the queries that training does not see (two of three), with what fits them, and a ranker trained on all of the others."""
    queries = asked(spark, d)
    dense, sparse = map(stored, _sides(spark, d, 60, queries))
    pairs = ranker.candidate_pairs(queries, docs(spark, d), dense, sparse)
    pairs = stored(pairs.withColumn("fits", ranker.holds_passage(F.col("query"), F.col("body"))).drop("query", "body"))
    return pairs.where(~_shown_in_training()), ranker.train(pairs.where(_shown_in_training()))


def _shown_in_training() -> Column:
    return F.crc32(F.col("query_id").cast("string").cast("binary")) % 3 == 0


def ranker_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best five candidates of each held-out query by the trained ranker."""
    pairs, model = _ranked_pairs(spark, d)
    scored = pairs.withColumn("score", F.round(model.score(F.col("x")), 6)).withColumnRenamed("rank", "was")
    return R.ranked(scored, 5, F.desc("score"), F.col("was"), F.col("id")).select(*ROW)


def ranker_precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision over the held-out queries' candidates: the trained ranker does no worse than the share of words held."""
    pairs, model = _ranked_pairs(spark, d)

    queries = asked(spark, d).where(~_shown_in_training()).select("query_id")

    def precision(by: ranker.PairRanker) -> DataFrame:
        """Over all of the queries, also those without a candidate, in whole millionths: equal precisions compare as equal however they are summed."""
        scored = pairs.withColumn("score", F.round(by.score(F.col("x")), 6)).withColumnRenamed("rank", "was")
        ap = M.average_precision(R.ranked(scored, 1 << 30, F.desc("score"), F.col("was"), F.col("id")))
        millionths = F.round(F.coalesce("ap", F.lit(0.0)) * 1_000_000).cast("long")
        return queries.join(ap, "query_id", "left").agg(F.count("*").alias("queries"), F.coalesce(F.sum(millionths), F.lit(0)).alias("ap"))

    a, b = precision(model), precision(ranker.OVERLAP)
    return a.crossJoin(b.select(F.col("ap").alias("of_overlap"))).select("queries", (F.col("ap") >= F.col("of_overlap")).alias("no_worse"))  # one row each


def word_associations(spark: SparkSession, d: str) -> DataFrame:
    """Which words stand near which, of the thousand words in most documents: the five with the largest mutual information of each."""
    words = embeddings.vocabulary(docs(spark, d), 1000, 5)
    found = embeddings.associations(docs(spark, d), words, 4)
    best = R.ranked(found.withColumn("pmi", F.round("pmi", 6)), 5, F.desc("pmi"), F.col("b"), key="a")
    name = lambda c, as_: words.select(F.col("place").alias(c), F.col("word").alias(as_))
    return best.join(name("a", "word"), "a").join(name("b", "other"), "b").select("word", "other", "rank", "n", "pmi")


def learned_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """As dense_topk, by embeddings learned from the documents."""
    embed = embeddings.learn(docs(spark, d)).column
    embedded = R.spread(docs(spark, d).select("id", "text")).select("id", embed(F.col("text")).alias("embedding"))
    return _shown(R.knn(embedded, asked(spark, d).select("query_id", embed(F.col("text")).alias("embedding")), 5))


def _vector_index(spark: SparkSession, d: str) -> str:
    folder = scratch(spark)
    vector_index.build(vectors(spark, d), folder, lists=32, codes=16, values=256)
    return folder


def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest vectors by an index of quantised residuals, three quarters of whose lists each query probes: those at hand have hardly any clusters."""
    return _shown(vector_index.search(spark, _vector_index(spark, d), query_vectors(spark, d), 5, probes=24, refine=10))


def ann_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of the exact results the index finds: at least nine of ten."""
    found = vector_index.search(spark, _vector_index(spark, d), query_vectors(spark, d), 5, probes=24, refine=10)
    per = vector_index.recall(found, R.knn(vectors(spark, d), query_vectors(spark, d), 5))
    return per.select("queries", (F.col("recall") >= 0.9).alias("reaches_nine_of_ten"))


def _text_index(spark: SparkSession, d: str, queries: DataFrame, k: int = 5, **options: int) -> tuple[DataFrame, DataFrame]:
    folder = scratch(spark)
    text_index.build(docs(spark, d), folder, **options)
    return text_index.search(spark, folder, queries, k)


def bm25_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """As bm25_topk, from postings in blocks of which those are scored whose bounds reach the best results."""
    return _text_index(spark, d, asked(spark, d))[0].select("query_id", "id", "rank", F.col("normalised").alias("score"))


def bm25_index_reads(spark: SparkSession, d: str) -> DataFrame:
    """How many postings the queries' terms of any weight have, and whether fewer were scored, in blocks of four documents."""
    read = _text_index(spark, d, asked(spark, d), docs_a_block=4)[1]
    return read.agg(F.count("*").alias("queries"), F.sum("of").alias("postings"), (F.sum("postings") < F.sum("of")).alias("fewer_scored"))


def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows, dimensions and labels of the vectors."""
    return vectors(spark, d).agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("least_dimension"), F.max(F.size("embedding")).alias("most_dimension"), F.countDistinct("label").alias("labels"))


def vectors_by_id(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of all labelled documents that have one, by one join on the id."""
    wanted = table(spark, d, "labels").select(F.col("doc_id").alias("id")).distinct()
    return vectors(spark, d).join(wanted, "id").select("id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


def filtered_by_two(spark: SparkSession, d: str) -> DataFrame:
    """Documents by two equalities."""
    return table(spark, d, "documents").where((F.col("lang") == "de") & (F.col("source") == "src3")).select("doc_id", "n_chars")


QUERIES = {f.__name__: f for f in (vector_topk_cosine, vector_topk_l2, vector_topk_filtered, knn_hit_precision_recall_mrr, bm25_topk, bm25_topk_source, dense_topk, timed_topk, hybrid_topk, hybrid_distance_topk, threshold_hybrid_topk, rerank_topk, hybrid_rerank_topk, threshold_rerank_topk, version_fallback_topk, first_queries, jaccard_relevance, tier1_metrics, tier1_by_pipeline, tier2_by_pipeline, keyword_metrics, keyword_by_method, keyword_index_totals, context_precision_ap, robustness, corpus_relevance, corpus_recall, ranker_topk, ranker_precision, word_associations, learned_dense_topk, ann_topk, ann_recall, bm25_index_topk, bm25_index_reads, collection_stats, vectors_by_id, filtered_by_two)}

_KNN = """WITH s AS (
  SELECT q.vec_id AS query_id, e.vec_id AS id, e.label, q.label AS query_label, round({score}, 12) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0{where}),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank FROM s) WHERE rank <= {k})
"""
_COS = "list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])))"
_L2 = "list_sum(list_transform(list_zip(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_knn = lambda score=_COS, where="", order="DESC", k=5: _KNN.format(score=score, where=where, order=order, k=k)
_LONG = "list_distinct(list_filter({}, lambda w: length(w) > 3))"
_a, _b = _LONG.format(WORDS.format("d.text")), _LONG.format(WORDS.format("b.text"))
_JACCARD = f"len(list_intersect({_a}, {_b})) / greatest(len(list_distinct(list_concat({_a}, {_b}))), 1)"
_FITS = f"(lower(b.text) <> '' AND (d.doc_id::VARCHAR = lower(b.text) OR contains(lower(coalesce(d.text, '')), lower(b.text)) OR contains(lower(b.text), lower(coalesce(d.text, ''))) OR {_JACCARD} > 0.4))"
#: As relevance.mean(), of a number between 0 and 1.
_mean = lambda c: f"((2 * sum(round(({c})::DOUBLE * 1000000)::BIGINT) + 100 * count({c})) // (200 * count({c}))) / 10000"
_means = lambda *names: ", ".join(f"{_mean(n)} AS {n}" for n in names)
_OUT = " SELECT query_id, id, round(score, 4) AS score, rank FROM {}"
_RERANK = """,
rr AS (
  SELECT h.query_id, h.id, h.rank AS was, round(1 / (1 + exp(-(8 * (len(list_intersect(qw, dwords)) / len(qw)) - 4))), 4) AS score
  FROM {0} h JOIN (SELECT doc_id AS id, list_distinct({1}) AS dwords FROM documents) USING (id)
  JOIN (SELECT item_id AS query_id, list_distinct({1}) AS qw FROM {2}) USING (query_id)),
rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS rank FROM rr) WHERE rank <= 5)"""
_reranked = lambda name, queries="benchmark": _RERANK.format(name, WORDS.format("text"), queries)
_rerank = lambda name: _reranked(name) + "\nSELECT query_id, id, score, rank FROM rk"
_ABOVE = ",\nab AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM hy) WHERE CASE WHEN best >= 0.2 THEN score >= 0.2 ELSE rank <= 5 END)"
_TIER1 = """fit AS (SELECT r.query_id, r.rank, {fits} AS fits FROM {name} r JOIN documents d ON d.doc_id = r.id JOIN benchmark b ON b.item_id = r.query_id WHERE rank <= 5),
m{name} AS (
  SELECT query_id, bool_or(fits) AS hit, count(*) FILTER (fits) / 5 AS precision, CASE WHEN bool_or(fits) THEN 1.0 ELSE 0.0 END AS recall, coalesce(1 / min(rank) FILTER (fits), 0.0) AS mrr
  FROM fit GROUP BY query_id)"""
_HYBRID = "WITH " + bm25_sql(15) + ",\n" + dense_sql(15) + ",\n" + fuse_sql(5, "0.5")
_WIDE = lambda alpha: "WITH " + bm25_sql(60) + ",\n" + dense_sql(60) + ",\n" + fuse_sql(20, alpha)
_FIRST = "(SELECT * FROM benchmark ORDER BY item_id LIMIT 20)"
_SCOPE = "coalesce(try_cast(regexp_extract(source, '[0-9]+') AS INT), 0) % 12 = 10"


def _pipeline(name: str, label: str) -> str:
    body = _TIER1.format(fits=_FITS, name=name).replace("fit AS", f"fit_{name} AS").replace("FROM fit GROUP", f"FROM fit_{name} GROUP")
    return body, f"SELECT '{label}' AS model, {_means('hit', 'precision', 'recall', 'mrr')} FROM m{name}"


_PIPELINES = (("Vector", "dn"), ("BM25", "bm"), ("Hybrid", "hy"), ("Hybrid+Rerank", "rk"))


def _four(queries: str = "benchmark") -> str:
    """CTEs of four pipelines over a table of queries."""
    return "WITH " + bm25_sql(60, queries=queries) + ",\n" + dense_sql(60) + ",\n" + fuse_sql(5, "0.5", within=15) + ",\n" + fuse_sql(20, "0.5", "wide") + _reranked("wide", queries)


def _runs_sql(queries: str) -> str:
    return _four(queries) + " " + " UNION ALL ".join(f"SELECT '{label}' AS model, query_id, id, rank FROM {name} WHERE rank <= 5" for label, name in _PIPELINES)


#: crc32 of an id as text, bit by bit, modulo 3.
_HELD_OUT = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(item_id::VARCHAR) + 1), lambda i: ascii(substr(item_id::VARCHAR, i::INTEGER, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 3 <> 0"""

_PARTS = [_pipeline(name, label) for label, name in _PIPELINES]

SQL = {
    "vector_topk_cosine": _knn() + _OUT.format("r"),
    "vector_topk_l2": _knn(_L2, order="ASC") + _OUT.format("r"),
    "vector_topk_filtered": _knn(where=" AND e.label = 3") + _OUT.format("r"),
    "knn_hit_precision_recall_mrr": _knn() + """, n AS (SELECT label, count(*) AS relevant FROM embeddings GROUP BY label),
p AS (SELECT query_id, query_label, count(*) FILTER (label = query_label) AS n, min(rank) FILTER (label = query_label) AS first FROM r GROUP BY ALL)
SELECT query_id, n > 0 AS hit, n / 5 AS precision, round(n / relevant, 6) AS recall, coalesce(round(1 / first, 6), 0.0) AS mrr FROM p JOIN n ON n.label = query_label""",
    "bm25_topk": "WITH " + bm25_sql(5) + " SELECT query_id, id, rank, normalised AS score FROM bm",
    "bm25_topk_source": "WITH " + bm25_sql(5, "source = 'src0'", True) + " SELECT query_id, id, rank, normalised AS score FROM bm",
    "dense_topk": "WITH " + bm25_sql(5) + ",\n" + dense_sql(5) + _OUT.format("dn"),
    "timed_topk": "WITH " + bm25_sql(5) + ",\n" + dense_sql(5) + " SELECT query_id, id, round(score, 4) AS score, rank, 'embedding_ms, retrieval_ms, total_ms' AS timed FROM dn",
    "hybrid_topk": _HYBRID + " SELECT query_id, id, score, rank FROM hy",
    "hybrid_distance_topk": "WITH " + bm25_sql(20) + ",\n" + dense_sql(20) + """,
da2 AS (SELECT query_id, id, coalesce(1 - (1 - score) / nullif(max(1 - score) OVER (PARTITION BY query_id), 0), 0.0) AS dense FROM dn),
h0 AS (SELECT query_id, id, round(0.5 * coalesce(dense, 0.0) + 0.5 * coalesce(normalised, 0.0), 9) AS score FROM da2 FULL OUTER JOIN bm USING (query_id, id)),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h0) WHERE rank <= 5) SELECT query_id, id, score, rank FROM h""",
    "threshold_hybrid_topk": _WIDE("0.3") + _ABOVE + " SELECT query_id, id, score, rank FROM ab",
    "rerank_topk": "WITH " + bm25_sql(20) + _rerank("bm"),
    "hybrid_rerank_topk": _WIDE("0.5") + _rerank("hy"),
    "threshold_rerank_topk": _WIDE("0.3") + _ABOVE + _rerank("ab"),
    "version_fallback_topk": "WITH " + CAL_SQL + ", a AS (WITH " + bm25_sql(5, _SCOPE) + " SELECT * FROM bm WHERE score > 0), z AS (WITH " + bm25_sql(5) + " SELECT * FROM bm) SELECT query_id, id, rank, normalised AS score, false AS fallback FROM a UNION ALL SELECT query_id, id, rank, normalised, true FROM z WHERE query_id NOT IN (SELECT query_id FROM a)",
    "jaccard_relevance": "WITH " + bm25_sql(5) + f" SELECT query_id, id, rank, {_FITS} AS fits FROM bm JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query_id",
    "tier1_metrics": "WITH " + bm25_sql(5) + ",\n" + _TIER1.format(fits=_FITS, name="bm") + " SELECT mbm.*, s.avg_similarity FROM mbm JOIN (SELECT query_id, round(avg(normalised), 4) AS avg_similarity FROM bm GROUP BY query_id) s USING (query_id)",
    "tier1_by_pipeline": _four() + ",\n" + ",\n".join(p[0] for p in _PARTS) + "\n" + " UNION ALL ".join(p[1] for p in _PARTS),
    "tier2_by_pipeline": f"""WITH a AS ({_runs_sql("benchmark")}), b AS ({_runs_sql(typos_sql("benchmark"))}),
f AS (SELECT a.*, coalesce(d.text, '') AS text, b.text AS query, {_FITS} AS fits FROM a JOIN documents d ON d.doc_id = id JOIN benchmark b ON b.item_id = query_id),
g AS (
  SELECT model, query_id, any_value(query) AS question, list(id) AS ids, string_agg('- Document [' || rank || ']: ' || text || chr(10), '' ORDER BY rank) AS said, lower(string_agg(text, ' ' ORDER BY rank)) AS ctx,
         coalesce(string_agg(text, ' ' ORDER BY rank) FILTER (fits), '') AS good, coalesce(string_agg(text, ' ' ORDER BY rank) FILTER (NOT fits), '') AS noise, count(*) FILTER (fits) AS n_good, count(*) FILTER (NOT fits) AS n_noise
  FROM f GROUP BY ALL),
w AS ({answer_sql("g", "question", "said")}),
c AS (SELECT *, lower(answer) AS la, {less_sql(CONTENT.format("answer"), M.ANSWER_STOP)} AS fw, {less_sql(CONTENT.format("question"), M.TRUTH_STOP)} AS tw, {CONTENT.format("answer")} AS aw,
  list_filter({CONTENT.format("noise")}, lambda x: NOT list_contains(list_concat({CONTENT.format("good")}, {CONTENT.format("question")}), x)) AS mis FROM w),
tv AS (SELECT model, query_id, side, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS k, count(*) AS c FROM (SELECT model, query_id, 'q' AS side, unnest({WORDS.format("question")}) AS term FROM w UNION ALL SELECT model, query_id, 'a', unnest({WORDS.format("answer")}) FROM w) GROUP BY ALL),
tn AS (SELECT model, query_id, sum(c * c) FILTER (side = 'q') AS nq, sum(c * c) FILTER (side = 'a') AS na FROM tv GROUP BY ALL),
td AS (SELECT x.model, x.query_id, sum(x.c * y.c) AS dot FROM tv x JOIN tv y USING (model, query_id, k) WHERE x.side = 'q' AND y.side = 'a' GROUP BY ALL),
ap AS (SELECT model, query_id, coalesce(avg(p) FILTER (fits), 0.0) AS context_precision FROM (SELECT *, count(*) FILTER (fits) OVER (PARTITION BY model, query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / rank AS p FROM f) GROUP BY ALL),
sb AS (SELECT model, query_id, list(id) AS bent FROM b GROUP BY ALL),
m AS (
  SELECT model, CASE WHEN {any_sql("la", M.REFUSALS)} THEN 1.0 ELSE {share_sql("fw")} END AS faithfulness, coalesce(dot / sqrt(nq * na), 0.0) AS answer_relevancy, context_precision, {share_sql("tw")} AS context_recall,
         CASE WHEN n_noise = 0 OR n_good = 0 OR len(mis) = 0 OR len(aw) = 0 THEN 0.0 ELSE len(list_intersect(aw, mis)) / len(aw) END AS noise_sensitivity,
         len(list_intersect(ids, coalesce(bent, []))) / len(list_distinct(list_concat(ids, coalesce(bent, [])))) AS robustness
  FROM c LEFT JOIN tn USING (model, query_id) LEFT JOIN td USING (model, query_id) JOIN ap USING (model, query_id) LEFT JOIN sb USING (model, query_id))
SELECT model, {_means(*TIER2)} FROM m GROUP BY model""",
    "keyword_metrics": "WITH " + bm25_sql(5) + f""",
k AS (SELECT item_id AS query_id, list_sort(list_transform({WORDS.format("text")}, lambda w, i: {{'n': -length(w), 'i': i, 'w': w}}))[1].w AS keyword FROM benchmark),
f AS (SELECT bm.query_id, rank, contains(lower(coalesce(text, '')), keyword) AS has FROM bm JOIN k USING (query_id) JOIN documents ON doc_id = id),
t AS (SELECT query_id, count(*) AS relevant FROM k JOIN documents ON contains(lower(text), keyword) GROUP BY query_id)
SELECT query_id, bool_or(has) AS hit, round(count(*) FILTER (has) / least(5, count(*)), 6) AS precision, round(count(*) FILTER (has) / greatest(coalesce(any_value(relevant), 0), 1), 6) AS recall, round(coalesce(1 / min(rank) FILTER (has), 0.0), 6) AS mrr
FROM f LEFT JOIN t USING (query_id) GROUP BY query_id""",
    "keyword_index_totals": f"""WITH k AS (SELECT item_id AS query_id, list_sort(list_transform({WORDS.format("text")}, lambda w, i: {{'n': -length(w), 'i': i, 'w': w}}))[1].w AS keyword FROM benchmark),
p AS (SELECT query_id, 'word' AS part, keyword FROM k UNION ALL SELECT query_id, 'start', substr(keyword, 1, 2) FROM k)
SELECT query_id, part, count(*) AS relevant FROM p JOIN documents ON contains(lower(text), keyword) GROUP BY ALL""",
    "keyword_by_method": _four() + f""",
k AS (SELECT item_id AS query_id, {WORDS.format("text")}[1] AS keyword FROM benchmark),
t AS (SELECT query_id, count(*) AS relevant FROM k JOIN documents ON contains(lower(text), keyword) GROUP BY query_id),
a AS ({" UNION ALL ".join(f"SELECT '{label}' AS method, query_id, id, rank FROM {name} WHERE rank <= 5" for label, name in _PIPELINES)}),
f AS (SELECT method, a.query_id, rank, contains(lower(coalesce(text, '')), keyword) AS has FROM a JOIN k USING (query_id) JOIN documents ON doc_id = id),
m AS (
  SELECT method, query_id, bool_or(has) AS hit, count(*) FILTER (has) / least(5, count(*)) AS precision, count(*) FILTER (has) / greatest(coalesce(any_value(relevant), 0), 1) AS recall, coalesce(1 / min(rank) FILTER (has), 0.0) AS mrr
  FROM f LEFT JOIN t USING (query_id) GROUP BY ALL)
SELECT method, {_means('hit', 'precision', 'recall', 'mrr')} FROM m GROUP BY method""",
    "robustness": "WITH a AS (WITH " + bm25_sql(5) + " SELECT * FROM bm), b AS (WITH " + bm25_sql(5, queries=typos_sql("benchmark")) + """ SELECT * FROM bm),
sa AS (SELECT query_id, list(id) AS x FROM a GROUP BY query_id), sb AS (SELECT query_id, list(id) AS y FROM b GROUP BY query_id)
SELECT query_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) AS robustness FROM sa JOIN sb USING (query_id)""",
    "first_queries": "WITH a AS (WITH " + bm25_sql(3, _SCOPE, queries=_FIRST) + " SELECT * FROM bm WHERE score > 0), z AS (WITH " + bm25_sql(3, queries=_FIRST) + " SELECT * FROM bm) SELECT query_id, id, rank, false AS fallback FROM a UNION ALL SELECT query_id, id, rank, true FROM z WHERE query_id NOT IN (SELECT query_id FROM a)",
    "corpus_relevance": f"""WITH s AS (SELECT doc_id AS id, {_LONG.format(WORDS.format("text"))} AS w FROM documents), t AS (SELECT id, unnest(w) AS t FROM s),
p AS (SELECT q.id AS query_id, t.id, count(*) AS meet FROM t q JOIN t ON q.t = t.t WHERE q.id % 20 = 0 GROUP BY ALL),
r AS (SELECT query_id, count(*) AS relevant FROM p JOIN s x ON x.id = query_id JOIN s y ON y.id = p.id WHERE meet / (len(x.w) + len(y.w) - meet) > 0.4 GROUP BY query_id)
SELECT id AS query_id, coalesce(relevant, 0) AS relevant FROM s LEFT JOIN r ON r.query_id = id WHERE id % 20 = 0""",
    "corpus_recall": "WITH " + bm25_sql(5) + f""",
s AS (SELECT doc_id AS id, {_LONG.format(WORDS.format("text"))} AS w FROM documents), q AS (SELECT item_id AS query_id, {_LONG.format(WORDS.format("text"))} AS w FROM benchmark),
p AS (SELECT query_id, id, count(*) AS meet FROM (SELECT query_id, unnest(w) AS t FROM q) JOIN (SELECT id, unnest(w) AS t FROM s) USING (t) GROUP BY ALL),
f AS (SELECT query_id, id FROM p JOIN q USING (query_id) JOIN s USING (id) WHERE meet / (len(q.w) + len(s.w) - meet) > 0.2)
SELECT query_id, count(f.id) AS relevant, CASE WHEN count(f.id) = 0 THEN 1.0 ELSE round(count(bm.id) / count(f.id), 6) END AS recall
FROM q LEFT JOIN f USING (query_id) LEFT JOIN bm USING (query_id, id) GROUP BY query_id""",
    "ranker_precision": "SELECT count(*) AS queries, true AS no_worse FROM (SELECT item_id, text FROM benchmark) WHERE " + _HELD_OUT,
    "word_associations": f"""WITH dw AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
v AS (SELECT word, row_number() OVER (ORDER BY df DESC, encode(word)) - 1 AS place FROM (SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(w) AS word FROM dw) GROUP BY word HAVING df >= 5) ORDER BY df DESC, encode(word) LIMIT 1000),
t AS (SELECT doc_id, i, place FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM dw) JOIN v USING (word)),
c AS (SELECT x.place AS a, y.place AS b, count(*) AS n FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i - 4 AND x.i + 4 AND x.i <> y.i GROUP BY ALL),
s AS (SELECT a, sum(n)::DOUBLE AS s FROM c GROUP BY a), z AS (SELECT sum(n)::DOUBLE AS total FROM c),
p AS (SELECT c.a, c.b, n, ln(n * total / (x.s * y.s)) AS pmi FROM c JOIN s x ON x.a = c.a JOIN s y ON y.a = c.b, z),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(pmi, 6) DESC, b) AS rank FROM p WHERE pmi > 0)
SELECT v.word, o.word AS other, rank, n, round(pmi, 6) AS pmi FROM r JOIN v ON v.place = a JOIN v o ON o.place = b WHERE rank <= 5""",
    "ann_recall": "SELECT count(*) AS queries, true AS reaches_nine_of_ten FROM embeddings WHERE vec_id % 20 = 0",
    "bm25_index_topk": "WITH " + bm25_sql(5) + " SELECT query_id, id, rank, normalised AS score FROM bm",
    "bm25_index_reads": "WITH " + bm25_sql(5) + " SELECT (SELECT count(*) FROM benchmark) AS queries, count(*) AS postings, true AS fewer_scored FROM (SELECT DISTINCT query_id, term FROM qtok) JOIN tf USING (term) JOIN idf USING (term) WHERE idf <> 0",
    "collection_stats": "SELECT count(*) AS n, min(len(embedding))::INT AS least_dimension, max(len(embedding))::INT AS most_dimension, count(DISTINCT label) AS labels FROM embeddings",
    "vectors_by_id": "SELECT vec_id AS id, label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
    "filtered_by_two": "SELECT doc_id, n_chars FROM documents WHERE lang = 'de' AND source = 'src3'",
    "context_precision_ap": _knn(k=10) + """, p AS (SELECT query_id, label = query_label AS fits, count(*) FILTER (label = query_label) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / rank AS p FROM r)
SELECT query_id, round(coalesce(avg(p) FILTER (fits), 0.0), 6) AS ap FROM p GROUP BY query_id""",
}
