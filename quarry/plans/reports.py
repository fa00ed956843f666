"""Queries about answers, classes, latencies and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.classify import ANCHORS, CHANGE_VERBS, COMPARISON, CROSS_VERSION, FEATURE_WORDS, NOTES, VERSION_WORDS, classify_query
from quarry.functions.vectors import cosine
from quarry.operators import answers as A
from quarry.operators import relevance as M
from quarry.operators.retrieval import bm25, hashed_embedding
from quarry.plans.tables import CAL_SQL, CONTENT, DOC_VERSION_SQL, FACTS_SQL, WORDS, answer_sql, any_sql, asked, bm25_sql, calendar_at, docs, facts, less_sql, share_sql, source_version, table
from quarry.sources.store import report_lines, scratch, write_csv, write_json


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Each turn with the one after it as its answer and the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.lead("text").over(w).alias("answer"), F.lag("text").over(w).alias("earlier"))


def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).where("answer is not null").select("conv_id", "turn", F.round(M.faithfulness(F.col("answer"), F.col("question")), 6).alias("faithfulness"))


def context_recall(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).where("answer is not null").select("conv_id", "turn", F.round(M.context_recall(F.col("question"), F.col("answer")), 6).alias("context_recall"))


def answer_relevancy(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the embeddings of question and answer; 0 for an empty answer."""
    t = _turns(spark, d).where("answer is not null")
    near = cosine(hashed_embedding(F.col("question")), hashed_embedding(F.col("answer")))
    return t.select("conv_id", "turn", F.round(F.when(F.col("answer") == "", 0.0).otherwise(near), 6).alias("answer_relevancy"))


def noise_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """The question's text is the relevant document, the turn before it the noise."""
    t = _turns(spark, d).where("answer is not null")
    noise = F.filter(F.array("earlier"), lambda x: x.isNotNull())
    return t.select("conv_id", "turn", F.round(M.noise_sensitivity(F.col("answer"), F.lit(""), F.array("question"), noise), 6).alias("noise_sensitivity"))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return M.latency("value", "event_type")(table(spark, d, "events"))


def stage_latency_avg(spark: SparkSession, d: str) -> DataFrame:
    """Means of a day's stages: the number in an event's properties is one stage, its value the other."""
    first = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), first.alias("embedding_ms"), F.col("value").alias("retrieval_ms"), (first + F.col("value")).alias("total_ms"))
    return e.groupBy("day").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("embedding_ms", "retrieval_ms", "total_ms")))


def classify_queries(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).select("query_id", classify_query(F.col("query")).alias("category"))


def category_distribution(spark: SparkSession, d: str) -> DataFrame:
    return M.shares(classify_queries(spark, d), "category")


def query_category_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.category_metrics(facts(spark, d))


def query_text_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Results without a query's text take it from the query set, where that has it."""
    f = facts(spark, d)
    results = f.select("query_id", F.when(F.col("query_id") % 3 == 0, "").when(F.col("query_id") % 7 == 0, F.lit(None)).otherwise(F.col("query")).alias("query"))
    known = M.with_query_text(results, f.where("query_id % 9 <> 0").select("query_id", "query"))
    return known.select("query_id", "query", classify_query(F.col("query")).alias("category"))


def console_report(spark: SparkSession, d: str) -> DataFrame:
    """The distribution of categories as lines for a console."""
    return report_lines(category_distribution(spark, d), 1)


def csv_sink(spark: SparkSession, d: str) -> DataFrame:
    """The failure categories as a CSV file with a header, as it is read again: text."""
    path = scratch(spark)
    write_csv(failure_summary(spark, d), path, 2)
    return spark.read.csv(path, header=True)


def json_sink(spark: SparkSession, d: str) -> DataFrame:
    """Latencies by event type as a JSON file, as it is read again."""
    path = scratch(spark)
    write_json(latency_percentiles(spark, d), path)
    return spark.read.schema("event_type string, p50 double, p95 double, p99 double, mean double, min double, max double, n long").json(path)


def parse_flag_lists(spark: SparkSession, d: str) -> DataFrame:
    """Judges' replies made of every event, of which three flags are read: JSON, lines of words, too few of them, nothing of use."""
    i = F.col("event_id")
    reply = F.when(i % 4 == 0, '{"relevance": [true, false, true, true]} and so on').when(i % 4 == 1, "1. Yes, it is\n2. No\nmaybe\n3. true").when(i % 4 == 2, "No.\nno opinion\nTRUE").otherwise("nothing to say")
    flags = A.parse_flags(reply, 3)
    return table(spark, d, "events").select("event_id", *(F.get(flags, F.lit(k)).alias(f"flag_{k}") for k in range(3)))


def judged_blend(spark: SparkSession, d: str) -> DataFrame:
    """The answer metrics, half by heuristics and half by a judge, here the canned one: its replies to the four prompts, parsed."""
    t = _turns(spark, d).where("answer is not null")
    noise = F.filter(F.array("earlier"), lambda x: x.isNotNull())
    said = lambda kind: A.parse_score(A.canned_reply(A.judge_prompt(kind, question=F.col("question"), answer=F.col("answer"), context=F.col("question"), truth=F.col("question"))))
    near = F.when(F.col("answer") == "", 0.0).otherwise(cosine(hashed_embedding(F.col("question")), hashed_embedding(F.col("answer"))))
    heuristics = {
        "faithfulness": M.faithfulness(F.col("answer"), F.col("question")), "answer_relevancy": near,
        "context_recall": M.context_recall(F.col("question"), F.col("answer")), "noise_sensitivity": M.noise_sensitivity(F.col("answer"), F.lit(""), F.array("question"), noise),
    }
    return t.select("conv_id", "turn", *(M.blend(F.round(h, 6), said(kind)).alias(kind) for kind, h in heuristics.items()))


def versioned_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Each query's prompt from its first documents, with a note on the version asked for; queries without one have no note."""
    found = bm25(docs(spark, d), asked(spark, d), 3).select("query_id", "id", "rank").join(docs(spark, d).select("id", "text", source_version().alias("version")), "id")
    rows = A.gather(found, "version").join(asked(spark, d).select("query_id", F.col("text").alias("question")), "query_id")
    target = F.when(F.col("query_id") % 4 != 0, calendar_at(F.col("query_id")))
    prompt = A.prompt(F.col("question"), F.col("docs"), target)
    return rows.select("query_id", F.length(prompt).alias("n_chars"), F.sha2(prompt, 256).alias("digest"))


def classify_failures(spark: SparkSession, d: str) -> DataFrame:
    return M.issues(facts(spark, d)).select("query_id", "query", "expected_version", "retrieved_version", "retrieved_chunks", "failure_category", "notes")


def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.shares(M.issues(facts(spark, d)), "failure_category")


def llm_fallback_answer(spark: SparkSession, d: str) -> DataFrame:
    t = _turns(spark, d)
    return t.select("conv_id", "turn", A.extract_answer(F.coalesce("earlier", F.lit("")), F.col("question")).alias("answer"))


def parse_scores(spark: SparkSession, d: str) -> DataFrame:
    """Replies made of every event: JSON, plain numbers and neither."""
    v, i = F.format_string("%.2f", F.col("value") % 1), F.col("event_id")
    reply = F.when(i % 3 == 0, F.concat(F.lit('Sure: {"reasoning": "ok", "score": '), v, F.lit("} done"))).when(i % 3 == 1, F.concat(F.lit("I say "), v, F.lit(" or 1"))).otherwise("no number at all")
    return table(spark, d, "events").select("event_id", F.round(A.parse_score(reply), 6).alias("score"))


def set_ops(spark: SparkSession, d: str) -> DataFrame:
    """Documents with and without labels, and sources of either kind of language."""
    doc, lab = table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels").select("doc_id").distinct()
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    en, other = doc.where("lang = 'en'").select("source").distinct(), doc.where("lang <> 'en'").select("source").distinct()
    parts = [n(doc.join(lab, "doc_id", "left_semi"), "labelled"), n(doc.join(lab, "doc_id", "left_anti"), "unlabelled"), n(en.intersect(other), "both"), n(en.union(other).distinct(), "either"), n(doc.select("lang").unionAll(doc.select("source")), "concatenated")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def foreign_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every finished order, as the comments of a film are found by its key."""
    o = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    return lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


QUERIES = {f.__name__: f for f in (faithfulness, context_recall, answer_relevancy, noise_sensitivity, latency_percentiles, stage_latency_avg, classify_queries, category_distribution, query_category_metrics, query_text_fallback, csv_sink, json_sink, parse_flag_lists, console_report, judged_blend, versioned_prompts, classify_failures, failure_summary, llm_fallback_answer, parse_scores, set_ops, foreign_key_lookup)}

_TURNS = """WITH t AS (SELECT conv_id, turn, text AS question, lead(text) OVER w AS answer, lag(text) OVER w AS earlier FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""
_V = r"(^|[^a-z0-9_])v?[0-9]+\.[0-9]+(\.[0-9]+)?($|[^a-z0-9_])"
_CATEGORY = f"""CASE WHEN {any_sql("q", COMPARISON)} THEN 'Comparison Query' WHEN {any_sql("q", CROSS_VERSION)} THEN 'Cross-Version Query' WHEN regexp_matches(q, '{_V}') OR {any_sql("q", VERSION_WORDS)} THEN 'Version-Specific Query'
  WHEN {any_sql("q", CHANGE_VERBS + FEATURE_WORDS)} THEN 'Feature/Change Query' ELSE 'General Fact Query' END"""
_CLASSED = f"WITH {FACTS_SQL}, cf AS (SELECT *, {_CATEGORY} AS category FROM (SELECT *, lower(query) AS q FROM facts))"
_SHARES = " SELECT {0}, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS share FROM {1} GROUP BY {0}"
_note = lambda k: "'" + NOTES[k].replace("{expected}", "' || expected_version || '").replace("{retrieved}", "' || retrieved_version || '").replace("{n}", "' || retrieved_chunks || '").replace("{k}", "5") + "'"
_FAILED = f"""WITH {FACTS_SQL},
g AS (SELECT *, retrieved_version <> 'none' AND retrieved_version = expected_version AS ok, NOT (regexp_matches(lower(query), '{_V}') OR {any_sql("lower(query)", ANCHORS)}) AS vague FROM facts WHERE retrieved_chunks = 0 OR temporal_leak OR retrieved_chunks < 5),
fl AS (SELECT *, CASE WHEN retrieved_chunks = 0 THEN ['No Relevant Chunk Retrieved', {_note("none")}] WHEN temporal_leak OR NOT ok THEN ['Wrong Version Retrieved', {_note("version")}]
  WHEN retrieved_chunks < 5 AND vague THEN ['Ambiguous Query', {_note("few")}] WHEN retrieved_chunks < 5 THEN ['Sparse Coverage', {_note("sparse")}] WHEN vague THEN ['Ambiguous Query', {_note("ambiguous")}] ELSE ['Wrong Chunk Retrieved', {_note("chunk")}] END AS f FROM g)"""

SQL = {
    "faithfulness": _TURNS + f""", c AS (SELECT conv_id, turn, lower(answer) AS a, lower(coalesce(question, '')) AS ctx, {less_sql(CONTENT.format("answer"), M.ANSWER_STOP)} AS ws FROM t WHERE answer IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN {any_sql("a", M.REFUSALS)} THEN 1.0 ELSE {share_sql("ws")} END, 6) AS faithfulness FROM c""",
    "context_recall": _TURNS + f""", c AS (SELECT conv_id, turn, lower(answer) AS ctx, {less_sql(CONTENT.format("question"), M.TRUTH_STOP)} AS ws FROM t WHERE answer IS NOT NULL)
SELECT conv_id, turn, round({share_sql("ws")}, 6) AS context_recall FROM c""",
    "answer_relevancy": _TURNS + f""", p AS (SELECT conv_id, turn, question, answer FROM t WHERE answer IS NOT NULL),
w AS (SELECT conv_id, turn, 'q' AS side, unnest({WORDS.format("question")}) AS term FROM p UNION ALL SELECT conv_id, turn, 'a', unnest({WORDS.format("answer")}) FROM p),
v AS (SELECT conv_id, turn, side, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b, count(*) AS c FROM w GROUP BY ALL),
n AS (SELECT conv_id, turn, side, sum(c * c) AS s FROM v GROUP BY ALL),
d AS (SELECT x.conv_id, x.turn, sum(x.c * y.c) AS dot FROM v x JOIN v y USING (conv_id, turn, b) WHERE x.side = 'q' AND y.side = 'a' GROUP BY ALL)
SELECT p.conv_id, p.turn, round(coalesce(CASE WHEN answer = '' THEN 0.0 ELSE dot / sqrt(nq.s * na.s) END, 0.0), 6) AS answer_relevancy
FROM p LEFT JOIN d USING (conv_id, turn) LEFT JOIN n nq ON nq.conv_id = p.conv_id AND nq.turn = p.turn AND nq.side = 'q' LEFT JOIN n na ON na.conv_id = p.conv_id AND na.turn = p.turn AND na.side = 'a'""",
    "noise_sensitivity": _TURNS + f""", c AS (SELECT conv_id, turn, {CONTENT.format("answer")} AS aw, {CONTENT.format("question")} AS rw, {CONTENT.format("earlier")} AS nw FROM t WHERE answer IS NOT NULL),
m AS (SELECT *, list_filter(nw, lambda w: NOT list_contains(rw, w)) AS mis FROM c)
SELECT conv_id, turn, round(CASE WHEN len(mis) = 0 OR len(aw) = 0 THEN 0.0 ELSE len(list_intersect(aw, mis)) / len(aw) END, 6) AS noise_sensitivity FROM m""",
    "latency_percentiles": """SELECT event_type, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_cont(value, 0.95), 3) AS p95, round(quantile_cont(value, 0.99), 3) AS p99, round(avg(value), 3) AS mean, round(min(value), 3) AS min, round(max(value), 3) AS max, count(value) AS n FROM events GROUP BY event_type""",
    "stage_latency_avg": "SELECT day, round(avg(k), 6) AS embedding_ms, round(avg(value), 6) AS retrieval_ms, round(avg(k + value), 6) AS total_ms FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, value, json_extract_string(props, '$.k')::DOUBLE AS k FROM events) GROUP BY day",
    "classify_queries": _CLASSED + " SELECT query_id, category FROM cf",
    "category_distribution": _CLASSED + _SHARES.format("category", "cf"),
    "query_category_metrics": _CLASSED + """ SELECT category, count(*) AS number_of_queries, count(*) FILTER (good) AS successful_retrievals, round(100 * avg(good::INT), 1) AS retrieval_accuracy, round(100 * avg(temporal_leak::INT), 1) AS temporal_leakage_rate,
  round(avg(retrieval_latency_ms), 1) AS average_latency_ms, round(quantile_cont(retrieval_latency_ms, 0.5), 1) AS p50_latency_ms, round(quantile_cont(retrieval_latency_ms, 0.95), 1) AS p95_latency_ms, round(avg(retrieved_chunks), 1) AS average_retrieved_chunks
FROM (SELECT *, retrieved_chunks > 0 AND NOT temporal_leak AS good FROM cf) GROUP BY category""",
    "classify_failures": _FAILED + " SELECT query_id, query, expected_version, retrieved_version, retrieved_chunks, f[1] AS failure_category, f[2] AS notes FROM fl",
    "failure_summary": _FAILED + _SHARES.format("failure_category", "(SELECT f[1] AS failure_category FROM fl)"),
    "llm_fallback_answer": _TURNS + ", a AS (" + answer_sql("(SELECT conv_id, turn, question, earlier FROM t)", "coalesce(earlier, '')", "coalesce(question, '')") + ") SELECT conv_id, turn, answer FROM a",
    "parse_scores": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN round(printf('%.2f', value % 1)::DOUBLE, 6) ELSE 0.5 END AS score FROM events",
    "set_ops": """SELECT 'labelled' AS what, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'both', count(*) FROM (SELECT source FROM documents WHERE lang = 'en' INTERSECT SELECT source FROM documents WHERE lang <> 'en') UNION ALL SELECT 'either', count(DISTINCT source) FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'concatenated', 2 * count(*) FROM documents""",
    "foreign_key_lookup": "SELECT l_orderkey, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY l_orderkey",
    "query_text_fallback": _CLASSED + """, g AS (SELECT query_id, CASE WHEN (query_id % 3 = 0 OR query_id % 7 = 0) AND query_id % 9 = 0 THEN '' ELSE query END AS query, category AS was FROM cf)
SELECT query_id, query, CASE WHEN query = '' THEN 'General Fact Query' ELSE was END AS category FROM g""",
    "console_report": _CLASSED + f""", r AS ({_SHARES.format("category", "cf")}),
t AS (SELECT category, n::VARCHAR AS n, printf('%.1f', share) AS share FROM r),
w AS (SELECT greatest(max(length(category)), 8) AS a, greatest(max(length(n)), 1) AS b, greatest(max(length(share)), 5) AS c FROM t)
SELECT 0 AS part, '' AS key, rtrim(rpad('category', a::INT, ' ') || ' | ' || rpad('n', b::INT, ' ') || ' | ' || rpad('share', c::INT, ' ')) AS line FROM w
UNION ALL SELECT 1, '', repeat('-', a) || '-+-' || repeat('-', b) || '-+-' || repeat('-', c) FROM w
UNION ALL SELECT 2, category, rtrim(rpad(category, a::INT, ' ') || ' | ' || rpad(n, b::INT, ' ') || ' | ' || rpad(share, c::INT, ' ')) FROM t, w""",
}
SQL["csv_sink"] = f"SELECT failure_category, n::VARCHAR AS n, printf('%.2f', share) AS share FROM ({SQL['failure_summary']})"
SQL["json_sink"] = SQL["latency_percentiles"]
SQL["parse_flag_lists"] = "SELECT event_id, event_id % 4 < 2 AS flag_0, false AS flag_1, event_id % 4 < 3 AS flag_2 FROM events"
_half = lambda score, c: f"round(CAST(0.5 * {score} + 0.5 * {c} AS DECIMAL(12,8)), 4)::DOUBLE AS {c}"
SQL["judged_blend"] = "SELECT conv_id, turn, " + ", ".join(_half(s, c) for c, s in A.CANNED.items()) + " FROM " + " JOIN ".join(f"({SQL[c]}) m{i}" + (" USING (conv_id, turn)" if i else "") for i, c in enumerate(A.CANNED))
SQL["versioned_prompts"] = f"""WITH {CAL_SQL}, {bm25_sql(3)},
l AS (SELECT query_id, string_agg('- Document [' || rank || '] (Version ' || {DOC_VERSION_SQL} || '): ' || text || chr(10), '' ORDER BY rank) AS said FROM bm JOIN documents ON doc_id = id GROUP BY query_id),
p AS (SELECT query_id, '{A.TASK}' || chr(10) || chr(10) || CASE WHEN query_id % 4 <> 0 THEN replace('{A.NOTE}', '{{version}}', (SELECT list(version ORDER BY o) FROM (SELECT version, row_number() OVER () AS o FROM cal))[1 + query_id % 12]) || chr(10) || chr(10) ELSE '' END || 'Context:' || chr(10) || said || chr(10) || 'Question: ' || text || chr(10) || 'Answer:' AS prompt FROM l JOIN benchmark ON item_id = query_id)
SELECT query_id, length(prompt) AS n_chars, sha256(prompt) AS digest FROM p"""
