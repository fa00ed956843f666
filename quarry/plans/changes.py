"""Queries about chunks, versions and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import versions as V
from quarry.functions.classify import EFFICIENCY, efficiency_text
from quarry.functions.text import chunk_markdown
from quarry.operators import changes as C
from quarry.operators import relevance as M
from quarry.operators import retrieval as R
from quarry.plans.tables import CAL_SQL, CHUNKS_SQL, PAIRS_SQL, WORDS, asked, bm25_sql, calendar_at, chunk_versions, chunks_sql, docs, pairs, source_version, table


def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document cut into chunks, with ids and digests."""
    cut = R.spread(docs(spark, d).select("id", "text")).select("id", F.posexplode(chunk_markdown(F.col("text"))).alias("chunk_index", "text"))
    return cut.select(V.markdown_chunk_id(F.concat(F.lit("doc"), F.col("id").cast("string")), F.lit("v1.0.0"), F.col("chunk_index")).alias("chunk_id"), "id", "chunk_index", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("checksum"))


def chunk_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return C.deduplicate_chunks(chunk_versions(spark, d)).select("version", "chunk_index", "checksum", "chunk_id")


def version_dates(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and sources of each version with its date."""
    return chunk_versions(spark, d).withColumn("version_date", F.col("version_date").cast("string")).groupBy("version", "version_date").agg(F.count("*").alias("chunks"), F.countDistinct("source_file").alias("sources"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    """What versions and names are read from file names, dots and dashes included: a page's number gives the version, the last part of its
    address the rest."""
    last = F.regexp_extract("url", r"^[^?#]*?([^/?#]+)/?(?:[?#].*)?$", 1)
    name = F.concat(F.lit("v"), (F.col("page_id") % 7).cast("string"), F.lit("."), (F.col("page_id") % 5).cast("string"), F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("."), (F.col("page_id") % 4).cast("string"))).otherwise(""), F.lit(" - Release_notes-"), last, F.lit(".md"))
    rows = table(spark, d, "pages").select("page_id", name.alias("name"))
    n = F.col("name")
    return rows.select("page_id", V.from_file_name(n).alias("version"), V.from_pdf_name(n).alias("pdf_version"), V.pdf_document_name(n).alias("pdf_name"), V.markdown_document_name(n).alias("md_name"), V.normalised_name(n).alias("plain_name"))


def detect_changes(spark: SparkSession, d: str) -> DataFrame:
    return C.detect_changes(chunk_versions(spark, d), pairs(spark))


def detect_changes_embedded(spark: SparkSession, d: str) -> DataFrame:
    """The same with embeddings, by which alike chunks at one place are no change: the table's own, and for chunks that it lacks, made
    from the text."""
    name = lambda c: F.concat(F.lit("d"), F.col(c).cast("string")).alias("chunk_id")
    stored = table(spark, d, "embeddings").select(name("vec_id"), "embedding")
    near = C.fetch_embeddings(stored, docs(spark, d).select(name("id"), "text"), R.hashed_embedding)
    return C.detect_changes(chunk_versions(spark, d), pairs(spark), near, 0.9)


def change_f1(spark: SparkSession, d: str) -> DataFrame:
    """The detection flag is another first letter of the digests; truth is another digest. Files here keep their name over versions: a file
    is the document's language."""
    chunks = chunk_versions(spark, d).withColumn("source_file", F.col("document_name"))
    out = C.change_scores(chunks, pairs(spark), F.substring("old_sum", 1, 1) != F.substring("new_sum", 1, 1))
    return out.select("old", "new", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def embedding_change_f1(spark: SparkSession, d: str) -> DataFrame:
    """The detection flag is a cosine below 0.95 of the chunks' embeddings; a missing vector or a zero norm detects nothing."""
    chunks = chunk_versions(spark, d).withColumn("source_file", F.col("document_name"))
    near = docs(spark, d).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("chunk_id"), R.hashed_embedding(F.col("text")).alias("embedding"))
    out = C.change_scores(chunks, pairs(spark), C.embedding_changed(F.col("old_e"), F.col("new_e"), 0.95), near)
    return out.select("old", "new", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def _truth(found: DataFrame) -> DataFrame:
    """A ground truth that differs from what is detected; the last pair has none."""
    off = lambda c: F.floor(F.col(c) * 1.15).cast("int").alias(c)
    return found.where("new <> 'v3.5.5'").select("old", "new", off("added"), off("deleted"), off("modified"), F.floor(F.col("detected") * 1.25).cast("int").alias("total"))


def change_tolerance(spark: SparkSession, d: str) -> DataFrame:
    found = detect_changes(spark, d)
    return C.within_tolerance(found, _truth(found))


def change_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return change_tolerance(spark, d).agg(F.round(F.avg(F.col("correct").cast("double")), 4).alias("accuracy"), F.count("*").alias("pairs"))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the newer version of each pair against the older: by document and place."""
    rows = chunk_versions(spark, d)
    newer = pairs(spark).join(rows.select("version", "document_name", "chunk_index", "checksum", "chunk_id"), F.col("new") == F.col("version"))
    older = C.latest(rows, ["version", "document_name", "chunk_index"], "checksum", "chunk_id").select(F.col("version").alias("old"), "document_name", "chunk_index", "checksum")
    return C.classify_incremental(newer, older, ("old", "document_name", "chunk_index"))


def incremental_ingest_stats(spark: SparkSession, d: str) -> DataFrame:
    return C.ingest_stats(_flagged(spark, d), "version")


def update_efficiency(spark: SparkSession, d: str) -> DataFrame:
    return C.update_efficiency(incremental_ingest_stats(spark, d)).withColumn("interpretation", efficiency_text(F.col("efficiency")))


def deleted_sources(spark: SparkSession, d: str) -> DataFrame:
    """Files of each pair's older version that the newer one lacks."""
    rows = chunk_versions(spark, d).select("version", "source_file").distinct()
    old = pairs(spark).join(rows, F.col("old") == F.col("version")).select("old", "new", "source_file")
    return old.join(rows.select(F.col("version").alias("new"), "source_file"), ["new", "source_file"], "left_anti").select("old", "new", "source_file")


def latest_record(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def consecutive_pairs(spark: SparkSession, d: str) -> DataFrame:
    versions = chunk_versions(spark, d).select("version", "version_date").distinct().withColumn("product", F.when(F.col("version").startswith("v5"), "b").otherwise("s"))
    return C.consecutive_pairs(versions)


def history_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of each version's date sees: the latest record of every place."""
    targets = V.calendar(spark).select(F.col("version").alias("target"), F.col("version_date").alias("target_date"))
    seen = C.history(chunk_versions(spark, d), targets)
    return seen.groupBy("target").agg(F.count("*").alias("chunks"), F.max("version_date").cast("string").alias("newest"), F.sum(F.length("chunk_id")).alias("id_chars"), F.max("chunk_id").alias("last_id"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    found = R.bm25(docs(spark, d), asked(spark, d), 5).join(docs(spark, d).withColumn("version", source_version()).select("id", "version"), "id")
    per = found.withColumn("expected", calendar_at(F.col("query_id")))
    late = V.version_date(F.col("version")) > V.version_date(F.col("expected"))
    leaked = F.array_join(F.array_sort(F.collect_set(F.when(late, F.col("version")))), ", ")
    return per.groupBy("query_id", "expected").agg(F.max(late).alias("leak"), leaked.alias("leaked"), F.coalesce(F.array_join(F.array_sort(F.collect_set("version")), ", "), F.lit("none")).alias("retrieved"))


def temporal_leakage(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def temporal_leakage_rate(spark: SparkSession, d: str) -> DataFrame:
    return M.leakage_rate(_leaks(spark, d))


def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose content has an older copy need no new embedding: hits and misses of each version."""
    rows = chunk_versions(spark, d)
    first = rows.groupBy("checksum").agg(F.min(F.struct("version_date", "chunk_id")).alias("first"))
    hit = F.col("first.chunk_id") != F.col("chunk_id")
    return rows.join(first, "checksum").groupBy("version").agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"))


def cross_topics(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred of versions x topics, the topics being the nations."""
    v = spark.createDataFrame([(i, *p) for i, p in enumerate(V.CALENDAR)], "i int, version string, date string")
    nations = F.broadcast(table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("topic")))  # 25 rows
    n = F.row_number().over(Window.orderBy("i", "n_nationkey"))
    rows = v.join(nations, F.lit(True)).withColumn("n", n).where("n <= 100")
    return rows.select(F.format_string("q%d", "n").alias("query_id"), F.format_string("What %s changes were introduced or modified in %s?", "topic", "version").alias("query"), F.col("version").alias("expected_version"))


QUERIES = {f.__name__: f for f in (chunk_documents, chunk_hash_dedupe, version_dates, file_names, detect_changes, detect_changes_embedded, change_f1, embedding_change_f1, change_tolerance, change_accuracy, incremental_ingest_stats, update_efficiency, deleted_sources, latest_record, consecutive_pairs, history_retrieval, temporal_leakage, temporal_leakage_rate, embedding_cache, cross_topics)}

_CLEAN = CHUNKS_SQL + """,
clean AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version, chunk_index, checksum ORDER BY source_file, chunk_index, chunk_id) AS n FROM cv) WHERE n = 1)"""
_DETECT = f"""WITH {PAIRS_SQL}, {_CLEAN},
rws AS (
  SELECT "old", "new", side, chunk_id, chunk_index, checksum, source_file, lower(trim(document_name)) AS name_key, lower(trim(section_header)) AS header_key
  FROM (SELECT *, unnest(['old', 'new']) AS side FROM pairs) p JOIN clean ON version = CASE side WHEN 'old' THEN "old" ELSE "new" END),
n1 AS (SELECT *, row_number() OVER (PARTITION BY "old", "new", side, name_key, header_key ORDER BY source_file, chunk_index, chunk_id) AS rn FROM rws),
m1 AS (SELECT a."old", a."new", a.chunk_id AS oid, b.chunk_id AS nid, a.checksum <> b.checksum AS ch FROM n1 a JOIN n1 b USING ("old", "new", name_key, header_key) WHERE a.side = 'old' AND b.side = 'new' AND a.rn = 1 AND b.rn = 1),
r2 AS (SELECT * FROM rws r WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1."old" = r."old" AND m1."new" = r."new" AND r.chunk_id = CASE r.side WHEN 'old' THEN oid ELSE nid END)),
n2 AS (SELECT *, row_number() OVER (PARTITION BY "old", "new", side, chunk_index ORDER BY source_file DESC, chunk_index DESC, chunk_id DESC) AS rn FROM r2),
m2 AS (SELECT a."old", a."new", a.chunk_id AS oid, b.chunk_id AS nid, a.checksum <> b.checksum AS ch FROM n2 a JOIN n2 b USING ("old", "new", chunk_index) WHERE a.side = 'old' AND b.side = 'new' AND a.rn = 1 AND b.rn = 1),
r3 AS (SELECT * FROM r2 r WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m2."old" = r."old" AND m2."new" = r."new" AND r.chunk_id = CASE r.side WHEN 'old' THEN oid ELSE nid END)),
ev AS (SELECT "old", "new", 'modified' AS kind FROM m1 WHERE ch UNION ALL SELECT "old", "new", 'modified' FROM m2 WHERE ch UNION ALL SELECT "old", "new", CASE side WHEN 'old' THEN 'deleted' ELSE 'added' END FROM r3),
det AS (SELECT "old", "new", count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'deleted') AS deleted, count(*) FILTER (kind = 'modified') AS modified, count(kind) AS detected FROM pairs LEFT JOIN ev USING ("old", "new") GROUP BY ALL)"""
_TOLERANCE = _DETECT + """,
tru AS (SELECT "old", "new", floor(added * 1.15)::INT AS added, floor(deleted * 1.15)::INT AS deleted, floor(modified * 1.15)::INT AS modified, floor(detected * 1.25)::INT AS total FROM det WHERE "new" <> 'v3.5.5'),
tol AS (SELECT d.*, t.added AS ta, t.deleted AS td, t.modified AS tm, coalesce(total, detected) AS actual, greatest(2, round_even(0.2 * coalesce(total, detected), 0)) AS w FROM det d LEFT JOIN tru t USING ("old", "new")),
res AS (SELECT "old", "new", detected, actual, abs(detected - actual) <= w AND coalesce(abs(added - ta) <= w + greatest(1, round_even(0.3 * ta, 0)), true) AND coalesce(abs(deleted - td) <= w + greatest(1, round_even(0.3 * td, 0)), true) AND coalesce(abs(modified - tm) <= w + greatest(1, round_even(0.3 * tm, 0)), true) AS correct FROM tol)"""
_FLAGGED = f"""WITH {PAIRS_SQL}, {CHUNKS_SQL},
older AS (SELECT version AS "old", document_name, chunk_index, arg_max(checksum, chunk_id) AS prior FROM cv GROUP BY ALL),
flagged AS (SELECT version, checksum IS DISTINCT FROM prior AS changed FROM pairs JOIN cv ON version = "new" LEFT JOIN older USING ("old", document_name, chunk_index)),
stats AS (SELECT version, count(*) AS total, count(*) FILTER (changed) AS updated, count(*) FILTER (NOT changed) AS skipped FROM flagged GROUP BY version)"""
_LEAKS = f"""WITH {CAL_SQL}, {bm25_sql(5)},
dv AS (SELECT doc_id AS id, version, version_date FROM (SELECT doc_id, (SELECT list(version ORDER BY ord) FROM (SELECT version, row_number() OVER () AS ord FROM cal))[1 + coalesce(try_cast(regexp_extract(source, '[0-9]+') AS INT), 0) % 12] AS version FROM documents) JOIN cal USING (version)),
exp AS (SELECT DISTINCT item_id AS query_id, (SELECT list(version ORDER BY ord) FROM (SELECT version, row_number() OVER () AS ord FROM cal))[1 + item_id % 12] AS expected FROM benchmark),
lk AS (
  SELECT query_id, expected, bool_or(dv.version_date > cal.version_date) AS leak, coalesce(array_to_string(list_sort(list(DISTINCT dv.version) FILTER (dv.version_date > cal.version_date)), ', '), '') AS leaked, array_to_string(list_sort(list(DISTINCT dv.version)), ', ') AS retrieved
  FROM bm JOIN dv USING (id) JOIN exp USING (query_id) JOIN cal ON cal.version = expected GROUP BY ALL)"""

SQL = {
    "chunk_hash_dedupe": "WITH " + _CLEAN + " SELECT version, chunk_index, checksum, chunk_id FROM clean",
    "version_dates": "WITH " + CHUNKS_SQL + " SELECT version, version_date::VARCHAR AS version_date, count(*) AS chunks, count(DISTINCT source_file) AS sources FROM cv GROUP BY ALL",
    "file_names": r"""WITH f AS (SELECT page_id, 'v' || page_id % 7 || '.' || page_id % 5 || CASE WHEN page_id % 3 <> 0 THEN '.' || page_id % 4 ELSE '' END || ' - Release_notes-' || regexp_extract(url, '^[^?#]*?([^/?#]+)/?(?:[?#].*)?$', 1) || '.md' AS name FROM pages),
s AS (SELECT *, regexp_replace(name, '\.[^.]*$', '') AS stem FROM f)
SELECT page_id, CASE WHEN regexp_matches(name, '\d+\.\d+\.\d+') THEN 'v' || regexp_extract(name, 'v?(\d+\.\d+\.\d+)', 1) ELSE 'unknown' END AS version,
  'v' || regexp_extract(name, 'v?(\d+\.\d+(?:\.\d+)?)', 1) AS pdf_version,
  trim(regexp_replace(translate(regexp_replace(stem, 'v?\d+\.\d+(?:\.\d+)?', '', 'g'), '_-', '  '), '\s+', ' ', 'g')) AS pdf_name,
  trim(replace(replace(stem, '_', ' '), 'Release ', '')) AS md_name, lower(trim(regexp_replace(name, '^v[\d.]+\s*[~\-–—]?\s*', ''))) AS plain_name FROM s""",
    "detect_changes": _DETECT + ' SELECT * FROM det',
    "detect_changes_embedded": _DETECT.replace("a.checksum <> b.checksum AS ch FROM n2 a JOIN n2 b", "a.checksum <> b.checksum AND NOT coalesce(CASE WHEN list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e) = 0 THEN 0 ELSE list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) END >= 0.9, false) AS ch FROM n2 a JOIN n2 b").replace("USING (\"old\", \"new\", chunk_index) WHERE", "USING (\"old\", \"new\", chunk_index) LEFT JOIN vec x ON x.chunk_id = a.chunk_id LEFT JOIN vec y ON y.chunk_id = b.chunk_id WHERE").replace("rws AS (", f"""wv AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b, count(*)::DOUBLE AS c FROM (SELECT doc_id, unnest({WORDS.format("text")}) AS term FROM documents) GROUP BY ALL),
hv AS (SELECT doc_id, map_from_entries(list((b, c))) AS m FROM wv GROUP BY doc_id),
vec AS (SELECT 'd' || doc_id AS chunk_id, coalesce(embedding::DOUBLE[], list_transform(range(64), lambda i: coalesce(m[i], 0.0)::DOUBLE)) AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id LEFT JOIN hv USING (doc_id)),
rws AS (""", 1) + " SELECT * FROM det",
    "chunk_documents": "WITH src AS (SELECT doc_id AS id, text FROM documents), " + chunks_sql("src") + " SELECT 'doc' || id || '__v1.0.0__chunk_' || chunk_index AS chunk_id, id, chunk_index, length(text) AS n_chars, sha256(text) AS checksum FROM chunks",
    "change_f1": f"""WITH {PAIRS_SQL}, {CHUNKS_SQL},
c2 AS (SELECT version, document_name AS source_file, chunk_index, chunk_id, checksum FROM cv),
cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version, chunk_index, checksum ORDER BY source_file, chunk_index, chunk_id) AS n FROM c2) WHERE n = 1),
fl AS (SELECT "old", "new", substr(a.checksum, 1, 1) <> substr(b.checksum, 1, 1) AS d, a.checksum <> b.checksum AS t FROM pairs JOIN cl a ON a.version = "old" JOIN cl b ON b.version = "new" AND a.source_file = b.source_file AND a.chunk_index = b.chunk_index),
n AS (SELECT "old", "new", count(*) FILTER (d AND t) AS tp, count(*) FILTER (d AND NOT t) AS fp, count(*) FILTER (NOT d AND t) AS fn FROM fl GROUP BY ALL),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM n)
SELECT "old", "new", tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN tp IS NULL THEN NULL ELSE coalesce(2 * p * r / nullif(p + r, 0), 0) END, 6) AS f1 FROM pairs LEFT JOIN pr USING ("old", "new")""",
    "embedding_change_f1": f"""WITH {PAIRS_SQL}, {CHUNKS_SQL},
c2 AS (SELECT doc_id, version, document_name AS source_file, chunk_index, chunk_id, checksum FROM cv),
cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version, chunk_index, checksum ORDER BY source_file, chunk_index, chunk_id) AS n FROM c2) WHERE n = 1),
wv AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 4))::INT % 64 AS b, count(*) AS c FROM (SELECT doc_id, unnest({WORDS.format("text")}) AS term FROM documents) GROUP BY ALL),
nv AS (SELECT doc_id, sum(c * c) AS s FROM wv GROUP BY doc_id),
pr0 AS (SELECT "old", "new", a.doc_id AS i, b.doc_id AS j, a.checksum <> b.checksum AS t FROM pairs JOIN cl a ON a.version = "old" JOIN cl b ON b.version = "new" AND a.source_file = b.source_file AND a.chunk_index = b.chunk_index),
dt AS (SELECT i, j, sum(x.c * y.c) AS dot FROM (SELECT DISTINCT i, j FROM pr0) JOIN wv x ON x.doc_id = i JOIN wv y ON y.doc_id = j AND x.b = y.b GROUP BY ALL),
fl AS (SELECT "old", "new", t, coalesce(coalesce(dot, 0) / sqrt(p.s * q.s) < 0.95, false) AS d FROM pr0 LEFT JOIN dt USING (i, j) LEFT JOIN nv p ON p.doc_id = i LEFT JOIN nv q ON q.doc_id = j),
n AS (SELECT "old", "new", count(*) FILTER (d AND t) AS tp, count(*) FILTER (d AND NOT t) AS fp, count(*) FILTER (NOT d AND t) AS fn FROM fl GROUP BY ALL),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM n)
SELECT "old", "new", tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN tp IS NULL THEN NULL ELSE coalesce(2 * p * r / nullif(p + r, 0), 0) END, 6) AS f1 FROM pairs LEFT JOIN pr USING ("old", "new")""",
    "change_tolerance": _TOLERANCE + " SELECT * FROM res",
    "change_accuracy": _TOLERANCE + " SELECT round(avg(correct::INT), 4) AS accuracy, count(*) AS pairs FROM res",
    "incremental_ingest_stats": _FLAGGED + " SELECT * FROM stats",
    "update_efficiency": _FLAGGED + f""", u AS (SELECT version, total, updated FROM stats UNION ALL SELECT 'all', sum(total), sum(updated) FROM stats), e AS (SELECT *, coalesce(round(updated / nullif(total, 0), 4), 0.0) AS efficiency FROM u)
SELECT version, total::BIGINT AS total, updated::BIGINT AS updated, efficiency, CASE WHEN efficiency < 0.2 THEN '{EFFICIENCY[0]}' WHEN efficiency < 0.5 THEN '{EFFICIENCY[1]}' ELSE '{EFFICIENCY[2]}' END AS interpretation FROM e""",
    "deleted_sources": f"""WITH {PAIRS_SQL}, {CHUNKS_SQL}, f AS (SELECT DISTINCT version, source_file FROM cv)
SELECT "old", "new", source_file FROM pairs JOIN f ON version = "old" WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.version = "new" AND g.source_file = f.source_file)""",
    "latest_record": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "consecutive_pairs": f"""WITH {CHUNKS_SQL}, v AS (SELECT DISTINCT version, version_date, CASE WHEN starts_with(version, 'v5') THEN 'b' ELSE 's' END AS product FROM cv)
SELECT * FROM (SELECT product, lag(version) OVER (PARTITION BY product ORDER BY version_date, version) AS "old", version AS "new" FROM v) WHERE "old" IS NOT NULL""",
    "history_retrieval": f"""WITH {CHUNKS_SQL}, h AS (
  SELECT c.version AS target, cv.*, row_number() OVER (PARTITION BY c.version, document_name, chunk_index ORDER BY cv.version_date DESC, source_file DESC, chunk_index DESC, chunk_id DESC) AS n FROM cal c JOIN cv ON cv.version_date <= c.version_date)
SELECT target, count(*) AS chunks, max(version_date)::VARCHAR AS newest, sum(length(chunk_id))::BIGINT AS id_chars, max(chunk_id) AS last_id FROM h WHERE n = 1 GROUP BY target""",
    "temporal_leakage": _LEAKS + " SELECT * FROM lk",
    "temporal_leakage_rate": _LEAKS + " SELECT count(*) AS total, count(*) FILTER (leak) AS leaks, coalesce(round(avg(leak::INT), 4), 0.0) AS leakage_rate FROM lk",
    "embedding_cache": f"""WITH {CHUNKS_SQL}, f AS (SELECT *, first_value(chunk_id) OVER (PARTITION BY checksum ORDER BY version_date, chunk_id) AS first FROM cv)
SELECT version, count(*) FILTER (first <> chunk_id) AS hits, count(*) FILTER (first = chunk_id) AS misses FROM f GROUP BY version""",
    "cross_topics": f"""WITH {CAL_SQL}, c AS (SELECT *, row_number() OVER () AS i FROM cal), n AS (SELECT version, lower(n_name) AS topic, row_number() OVER (ORDER BY i, n_nationkey) AS n FROM c CROSS JOIN nation)
SELECT 'q' || n AS query_id, 'What ' || topic || ' changes were introduced or modified in ' || version || '?' AS query, version AS expected_version FROM n WHERE n <= 100""",
}
