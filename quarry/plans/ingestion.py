"""Queries that go the whole way of ingestion: files, chunks, and both stores, brought up to date twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import versions as V
from quarry.operators.retrieval import hashed_embedding, spread
from quarry.plans.tables import CAL_SQL, DOC_VERSION_SQL, chunks_sql, docs, source_version, strip_sql, words_sql
from quarry.sources.readers import markdown_chunks, page_chunks
from quarry.sources.store import RECORDS, VECTORS, Store, compare_updates, dropped, ingest, scratch
from quarry.streaming.ingest import ingest_stream

#: What some files have gained when they are scanned again.
ADDED = "A paragraph that the second scan finds. It is long enough to be kept."


def files(spark: SparkSession, d: str, again: bool = False) -> DataFrame:
    """Every document as a markdown file of its source's version. Scanned again, a seventh of them is gone, a fifth has a paragraph more,
    and some have become shorter."""
    rows = docs(spark, d).select("id", F.coalesce("text", F.lit("")).alias("text"), source_version().alias("version"))
    if again:
        text = F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("\n\n" + ADDED))).when(F.col("id") % 11 == 0, F.substring("text", 1, 500)).otherwise(F.col("text"))
        rows = rows.where("id % 7 <> 0").withColumn("text", text)
    name = F.concat(F.lit("doc"), F.col("id").cast("string"), F.lit(" "), F.substring("version", 2, 20), F.lit(".md"))
    return spread(rows.select(name.alias("source_file"), "text"))


def _twice(spark: SparkSession, d: str) -> tuple[Store, Store, DataFrame]:
    """Both stores after the two scans, and the second one's stats."""
    folder = scratch(spark)
    records, vectors = Store(spark, f"{folder}/records", RECORDS, "chunk_id", 16), Store(spark, f"{folder}/vectors", VECTORS, "chunk_id", 16)
    ingest(markdown_chunks(files(spark, d)), records, vectors, hashed_embedding)
    return records, vectors, ingest(markdown_chunks(files(spark, d, True)), records, vectors, hashed_embedding)


def ingest_twice_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the second ingestion found, embedded and skipped, by version."""
    return _twice(spark, d)[2].groupBy("version").agg(F.sum("total").alias("total"), F.sum("updated").alias("updated"), F.sum("skipped").alias("skipped"))


def ingest_twice_records(spark: SparkSession, d: str) -> DataFrame:
    """The store of records after both: every chunk with its flag."""
    return _twice(spark, d)[0].read().select("chunk_id", "document_name", "version", F.col("version_date").cast("string").alias("version_date"), "section_header", "source_file", "chunk_index", "checksum", "changed_flag")


def ingest_twice_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The store of vectors after both: every chunk's content, and how many words its embedding counts."""
    rows = _twice(spark, d)[1].read()
    return rows.select("chunk_id", "version", "checksum", F.length("text").alias("n_chars"), F.size("embedding").alias("dimensions"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("words"))


def restored_store(spark: SparkSession, d: str) -> DataFrame:
    """The store of records after it was brought back to the first scan."""
    records = _twice(spark, d)[0]
    records.restore(1)
    return records.read().groupBy("version").agg(F.count("*").alias("chunks"), F.countDistinct("source_file").alias("files"), F.max("checksum").alias("last_checksum"))


def _streamed(spark: SparkSession, d: str) -> tuple[Store, Store]:
    """Both stores after a stream has met the files, was ended, and went on with their second scan. Files that are gone are no event."""
    folder = scratch(spark)
    records, vectors = Store(spark, f"{folder}/records", RECORDS, "chunk_id", 16), Store(spark, f"{folder}/vectors", VECTORS, "chunk_id", 16)
    for scan in (False, True):
        arrived = files(spark, d, scan).select("source_file", "text", F.lit(int(scan)).cast("timestamp").alias("arrived"), F.lit("").alias("path"))
        arrived.write.mode("append").option("compression", "zstd").parquet(f"{folder}/in")
        stream = spark.readStream.schema(arrived.schema).parquet(f"{folder}/in")
        ingest_stream(stream, f"{folder}/checkpoint", records, vectors, hashed_embedding).awaitTermination()
        dropped(spark, f"{folder}/in")  # a stream does not go back to files that it has read
    return records, vectors


def streamed_records(spark: SparkSession, d: str) -> DataFrame:
    """The store of records after the stream: what the batch makes, and the chunks of files that are gone, as first seen."""
    return _streamed(spark, d)[0].read().select("chunk_id", "version", "section_header", "source_file", "chunk_index", "checksum", "changed_flag")


def streamed_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The store of vectors after the stream."""
    rows = _streamed(spark, d)[1].read()
    return rows.select("chunk_id", "checksum", F.length("text").alias("n_chars"), F.size("embedding").alias("dimensions"), F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x).alias("words"))


def files_by_date(spark: SparkSession, d: str) -> DataFrame:
    """Files in the order of their versions' dates."""
    version = V.from_file_name(F.col("source_file"))
    return files(spark, d).select("source_file", version.alias("version"), V.version_date(version).cast("string").alias("version_date")).orderBy("version_date", "source_file")


def rebuilt_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The store of vectors after its embeddings were made anew by another model, here one of eight dimensions."""
    vectors = _twice(spark, d)[1]
    vectors.rebuild(lambda df: df.withColumn("embedding", hashed_embedding(F.col("text"), 8)))
    return vectors.read().groupBy("version").agg(F.count("*").alias("chunks"), F.max(F.size("embedding")).alias("dimensions"), F.sum(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).alias("words"))


def update_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that a full and an incremental ingestion of the second scan embed."""
    folder, again = scratch(spark), markdown_chunks(files(spark, d, True))
    fresh = Store(spark, f"{folder}/records", RECORDS, "chunk_id", 16), Store(spark, f"{folder}/vectors", VECTORS, "chunk_id", 16)
    n = compare_updates(lambda: ingest(again, *fresh, hashed_embedding, force=True), lambda: _twice(spark, d)[2])
    return spark.createDataFrame([("full", int(n["chunks_processed_full"])), ("incremental", int(n["chunks_processed_incremental"]))], "mode string, chunks long")


def paged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of two pages, the first with a heading of one of four kinds: chunks, their headers and places over the file."""
    rows = docs(spark, d).select("id", F.coalesce("text", F.lit("")).alias("text"))
    heading = F.element_at(F.array(*(F.concat(F.lit(a), F.col("id").cast("string"), F.lit(b)) for a, b in HEADINGS)), (F.col("id") % len(HEADINGS) + 1).cast("int"))
    pages = F.array(F.struct(F.lit(1).alias("page"), F.concat(heading, F.lit("\n\n"), "text").alias("text")), F.struct(F.lit(2).alias("page"), F.substring("text", 100, 900).alias("text")))
    paged = spread(rows).select(F.concat(F.lit("g"), F.col("id").cast("string"), F.lit("_3.5.4.pdf")).alias("source_file"), F.explode(pages).alias("p")).select("source_file", "p.page", "p.text")
    return page_chunks(paged).select("chunk_id", "document_name", "version", F.col("version_date").cast("string").alias("version_date"), "page_number", "section_header", "chunk_index", "checksum")


#: What stands around a number in the headings of paged documents.
HEADINGS = (("# Part ", " #"), ("CHAPTER ", ""), ("Some words of part ", " follow:"), ("not a heading, number ", " of this"))


QUERIES = {f.__name__: f for f in (ingest_twice_stats, ingest_twice_records, ingest_twice_vectors, restored_store, rebuilt_vectors, update_comparison, streamed_records, streamed_vectors, files_by_date, paged_chunks)}

_FILES = f"""WITH {CAL_SQL},
f1 AS (SELECT doc_id AS id, {DOC_VERSION_SQL} AS version, coalesce(text, '') AS text FROM documents),
f2 AS (SELECT id, version, CASE WHEN id % 5 = 0 THEN text || chr(10) || chr(10) || '{ADDED}' WHEN id % 11 = 0 THEN substr(text, 1, 500) ELSE text END AS text FROM f1 WHERE id % 7 <> 0),
c1 AS (WITH {chunks_sql("f1")} SELECT id, chunk_index, text, sha256(text) AS checksum FROM chunks),
c2 AS (WITH {chunks_sql("f2")} SELECT id, chunk_index, text, sha256(text) AS checksum FROM chunks),
named AS (SELECT f1.id, version, version_date::VARCHAR AS version_date, 'doc' || id || ' ' || substr(version, 2) || '.md' AS source_file FROM f1 JOIN cal USING (version)),
seen AS (SELECT c2.*, named.* EXCLUDE (id), (c1.checksum IS DISTINCT FROM c2.checksum)::INT AS changed_flag FROM c2 JOIN named USING (id) LEFT JOIN c1 USING (id, chunk_index))"""

_STREAMED = """,
every AS (
  SELECT version, source_file, chunk_index, checksum, text, changed_flag FROM seen
  UNION ALL SELECT version, source_file, chunk_index, checksum, text, 1 FROM c1 JOIN named USING (id) WHERE id % 7 = 0)"""

_HEADING = "CASE id % 4 " + " ".join(f"WHEN {i} THEN '{a}' || id || '{b}'" for i, (a, b) in enumerate(HEADINGS)) + " END"
_PAGED = rf"""WITH src AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents),
pg AS (SELECT id, 1 AS page, {_HEADING} || chr(10) || chr(10) || text AS text FROM src UNION ALL SELECT id, 2, substr(text, 100, 900) FROM src),
ps AS (SELECT id, page, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n{{2,}}'), lambda p: {strip_sql("p")}), lambda p: p <> '') AS ps FROM pg),
fo AS (SELECT id, page, list_reduce(list_concat([''], ps), lambda acc, x: CASE WHEN acc = '' THEN x WHEN length(list_last(string_split(acc, chr(31)))) + length(x) + 2 <= 800 THEN acc || chr(10) || chr(10) || x ELSE acc || chr(31) || x END) AS said FROM ps),
li AS (SELECT id, page, list_filter(string_split(said, chr(31)), lambda c: c <> '') AS cs FROM fo),
ch AS (SELECT id, page, unnest(range(len(cs))) AS pos, unnest(cs) AS text FROM li),
nu AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page, pos) - 1 AS i, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql("x")}), lambda x: x <> '') AS lines FROM ch),
he AS (SELECT *, list_filter(lines, lambda x: starts_with(x, '#') OR (length(x) < 60 AND ((regexp_replace(x, '\P{{L}}', '', 'g') <> '' AND x = upper(x)) OR (regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '(^|\P{{L}})\p{{Ll}}|\p{{L}}\p{{Lu}}')) OR ends_with(x, ':'))))[1] AS h FROM nu)
SELECT 'g' || id || '_3.5.4.pdf__v3.5.4_p' || page || '_c' || i AS chunk_id, 'g' || id AS document_name, 'v3.5.4' AS version, '2024-12-18' AS version_date, page AS page_number,
       coalesce(CASE WHEN starts_with(h, '#') THEN {strip_sql("regexp_replace(h, '^#+', '')")} ELSE regexp_replace(h, ':+$', '') END, 'Section Page ' || page) AS section_header, i AS chunk_index, sha256(text) AS checksum FROM he"""

SQL = {
    "ingest_twice_stats": _FILES + " SELECT version, count(*) AS total, sum(changed_flag)::BIGINT AS updated, sum(1 - changed_flag)::BIGINT AS skipped FROM seen GROUP BY version",
    "ingest_twice_records": _FILES + " SELECT source_file || '__' || version || '__chunk_' || chunk_index AS chunk_id, regexp_replace(source_file, '.md$', '') AS document_name, version, version_date, 'Section ' || (chunk_index + 1) AS section_header, source_file, chunk_index, checksum, changed_flag FROM seen",
    "ingest_twice_vectors": _FILES + f" SELECT source_file || '__' || version || '__chunk_' || chunk_index AS chunk_id, version, checksum, length(text) AS n_chars, 64 AS dimensions, len({words_sql('text')})::DOUBLE AS words FROM seen",
    "restored_store": _FILES + " SELECT version, count(*) AS chunks, count(DISTINCT source_file) AS files, max(checksum) AS last_checksum FROM c1 JOIN named USING (id) GROUP BY version",
    "rebuilt_vectors": _FILES + f" SELECT version, count(*) AS chunks, 8 AS dimensions, sum(len({words_sql('text')}))::DOUBLE AS words FROM seen GROUP BY version",
    "update_comparison": _FILES + " SELECT 'full' AS mode, count(*) AS chunks FROM seen UNION ALL SELECT 'incremental', sum(changed_flag)::BIGINT FROM seen",
    "streamed_records": _FILES + _STREAMED + " SELECT source_file || '__' || version || '__chunk_' || chunk_index AS chunk_id, version, 'Section ' || (chunk_index + 1) AS section_header, source_file, chunk_index, checksum, changed_flag FROM every",
    "streamed_vectors": _FILES + _STREAMED + f" SELECT source_file || '__' || version || '__chunk_' || chunk_index AS chunk_id, checksum, length(text) AS n_chars, 64 AS dimensions, len({words_sql('text')})::DOUBLE AS words FROM every",
    "paged_chunks": _PAGED,
    "files_by_date": _FILES + " SELECT source_file, version, version_date FROM named",
}
