"""Queries that read raw files: JSON arrays made of the tables, written to the shared folder and scanned."""

from __future__ import annotations

import hashlib
import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.versions import CALENDAR
from quarry.plans.tables import CAL_SQL, CHUNKS_SQL, chunk_versions, chunks_sql, table
from quarry.sources import readers
from quarry.sources.store import scratch

#: Records of one JSON array: a file is read whole, by one task.
AT_ONCE = 1000


def _arrays(rows: DataFrame, key: Column, record: Column) -> str:
    """Writes JSON arrays of the records, so many to a file, and returns their folder."""
    path = scratch(rows.sparkSession)
    arrays = rows.groupBy(F.floor(key / AT_ONCE).alias("bucket")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(record)), ",\n"), F.lit("]")).alias("value"))
    arrays.write.partitionBy("bucket").text(path)
    return path


def scanned_movies(spark: SparkSession, d: str) -> DataFrame:
    """Parts as films: extended ids, numbers as numbers, text or nothing, lists that are empty or missing."""
    k, words = F.col("p_partkey"), F.split("p_type", " ")
    some = lambda n, c: F.when(k % n != 0, c)
    record = F.to_json(F.struct(
        F.when(k % 2 == 0, F.to_json(F.struct(k.cast("string").alias("$oid")))).otherwise(F.to_json(F.struct(F.concat(F.lit("x"), k.cast("string")).alias("$oid")))).alias("_id"),
        F.col("p_name").alias("title"), some(3, words).alias("genres"), F.array(F.col("p_brand"), F.col("p_name")).alias("cast"), some(5, F.array("p_brand")).alias("directors"),
        F.array(F.concat("p_name", F.lit(" (story)"))).alias("writers"), (1900 + F.col("p_size")).alias("year"), F.when(k % 4 == 0, F.lit("90 min")).otherwise(F.col("p_size").cast("string")).alias("runtime"),
        F.struct(F.concat(F.col("p_size").cast("string"), F.lit(" wins.")).alias("text"), F.col("p_size").alias("wins")).alias("awards"), F.struct(some(7, F.col("p_retailprice")).alias("rating"), (k * 3).alias("votes")).alias("imdb"), some(6, k).alias("num_mflix_comments"),
    ))
    record = F.regexp_replace(record, r'"_id":"\{\\"\$oid\\":\\"([^"\\]*)\\"\}"', r'"_id":{"\$oid":"$1"}')  # an object, not its text
    out = readers.movies(spark, _arrays(table(spark, d, "part"), k, record))
    return out.select("id", "text", "source", "title", "year", "genres", "directors", "runtime", "num_mflix_comments", F.round("imdb_rating", 2).alias("imdb_rating"), "imdb_votes", "award_wins", "type")


def scanned_comments(spark: SparkSession, d: str) -> DataFrame:
    """Turns of conversations as comments; those that say nothing are left out."""
    k = F.col("conv_id") * 1000 + F.col("turn")
    said = F.when(k % 5 == 0, F.lit(" \n")).otherwise(F.col("text"))
    record = F.to_json(F.struct(k.cast("string").alias("_id"), F.col("role").alias("name"), F.concat("role", F.lit("@example.com")).alias("email"), F.struct(F.col("conv_id").cast("string").alias("$oid")).alias("movie_id"), F.struct((k * 7).cast("string").alias("$date")).alias("date"), said.alias("text")))
    return readers.comments(spark, _arrays(table(spark, d, "conversations"), k, record))


def scanned_queries(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as a query set with its ground truths."""
    k = F.col("item_id")
    record = F.to_json(F.struct(F.concat(F.lit("q"), k.cast("string")).alias("query_id"), F.col("text").alias("query"), F.array(k.cast("string"), (k + 1).cast("string")).alias("relevant_documents")))
    rows = readers.json_records(spark, _arrays(table(spark, d, "benchmark"), k, record), "query_id string, query string, relevant_documents array<string>")
    return rows.select("query_id", "query", F.size("relevant_documents").alias("n_relevant"), F.get("relevant_documents", F.lit(1)).alias("second"))


def scanned_truth(spark: SparkSession, d: str) -> DataFrame:
    """A ground truth of version pairs, with a missing count and a pair that comes twice."""
    n = chunk_versions(spark, d).groupBy("version").agg(F.count("*").cast("int").alias("n"), F.countDistinct("document_name").cast("int").alias("m"))
    pair = lambda added: F.struct(F.lit("first").alias("old_version"), F.col("version").alias("new_version"), added.alias("added_chunks_count"), F.col("m").alias("modified_chunks_count"), F.col("n").alias("total_actual_changes"))
    path = scratch(spark)
    n.groupBy().agg(F.to_json(F.struct(F.flatten(F.collect_list(F.array(pair(F.lit(-1)), pair(F.col("n"))))).alias("version_pairs"))).alias("value")).write.text(path)
    return readers.change_truth(spark, path)


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, wherever the path leads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, False)
    out.write(bytearray(data))
    out.close()


def scanned_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Every nation as a markdown file of some version, with long and short paragraphs and either kind of line end: its chunks."""
    folder = scratch(spark)
    for r in table(spark, d, "nation").orderBy("n_nationkey").collect():  # 25 rows
        k, name, end = r["n_nationkey"], r["n_name"], "\r\n" if r["n_nationkey"] % 2 else "\n"
        text = [f"# {name}", f"The land of {name} has its own rules. " * (20 + k), "Short.", f"What is new in {name}? Little! " * (k + 1)]
        _put(spark, f"{folder}/land of {name} {CALENDAR[k % len(CALENDAR)][0][1:]}.md", (end * 2).join(text).encode())
    _put(spark, f"{folder}/read me.txt", b"no markdown, however long this text may be")
    found = readers.markdown_chunks(readers.markdown_files(spark, folder))
    return found.select("chunk_id", "document_name", "version", F.col("version_date").cast("string").alias("version_date"), "section_header", "source_file", "chunk_index", "checksum")


def scanned_sqlite(spark: SparkSession, d: str) -> DataFrame:
    """Every nation as a record in an SQLite file, of which one version is read."""
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE chunk_versions (chunk_id TEXT, source_file TEXT, version TEXT, version_date TEXT, chunk_index INTEGER, checksum TEXT)")
    rows = table(spark, d, "nation").collect()  # 25 rows
    db.executemany("INSERT INTO chunk_versions VALUES (?, ?, ?, '2024-02-01', ?, ?)", [(f"c{r['n_nationkey']}", r["n_name"], f"v{r['n_regionkey']}", r["n_nationkey"], hashlib.sha256(r["n_name"].encode()).hexdigest()) for r in rows])
    db.commit()
    path = f"{scratch(spark)}/old.db"
    _put(spark, path, db.serialize())
    db.close()
    return readers.sqlite_records(spark, path, version="v1").select("chunk_id", "source_file", F.col("version_date").cast("string").alias("version_date"), "chunk_index", "checksum", F.coalesce("document_name", F.lit("none")).alias("document_name"))


QUERIES = {f.__name__: f for f in (scanned_markdown, scanned_sqlite, scanned_movies, scanned_comments, scanned_queries, scanned_truth)}

_PART = "concat_ws('. ', 'Title: ' || p_name, CASE WHEN p_partkey % 3 <> 0 THEN 'Genres: ' || replace(p_type, ' ', ', ') END, 'Cast: ' || p_brand || ', ' || p_name, CASE WHEN p_partkey % 5 <> 0 THEN 'Directors: ' || p_brand END, 'Writers: ' || trim(string_split(p_name, '(')[1]), 'Year: ' || (1900 + p_size), 'Awards: ' || p_size || ' wins.')"
SQL = {
    "scanned_markdown": f"""WITH {CAL_SQL}, nat AS (SELECT n_nationkey AS id, n_name AS name, (SELECT list(version ORDER BY o) FROM (SELECT version, row_number() OVER () AS o FROM cal))[1 + n_nationkey % {len(CALENDAR)}] AS version FROM nation),
src AS (SELECT id, '# ' || name || chr(10) || chr(10) || repeat('The land of ' || name || ' has its own rules. ', 20 + id) || chr(10) || chr(10) || 'Short.' || chr(10) || chr(10) || repeat('What is new in ' || name || '? Little! ', id + 1) AS text FROM nat),
{chunks_sql("src")},
n2 AS (SELECT id, 'land of ' || name || ' ' || substr(version, 2) AS stem, version, version_date::VARCHAR AS version_date FROM nat JOIN cal USING (version))
SELECT stem || '.md__' || version || '__chunk_' || chunk_index AS chunk_id, replace(stem, '_', ' ') AS document_name, version, version_date, 'Section ' || (chunk_index + 1) AS section_header, stem || '.md' AS source_file, chunk_index, sha256(text) AS checksum FROM chunks JOIN n2 USING (id)""",
    "scanned_sqlite": "SELECT 'c' || n_nationkey AS chunk_id, n_name AS source_file, '2024-02-01' AS version_date, n_nationkey AS chunk_index, sha256(n_name) AS checksum, 'none' AS document_name FROM nation WHERE n_regionkey = 1",
    "scanned_movies": f"""SELECT 'movie_' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'x' END || p_partkey AS id, {_PART} AS text, 'movies' AS source, p_name AS title, 1900 + p_size AS year, CASE WHEN p_partkey % 3 <> 0 THEN replace(p_type, ' ', ', ') ELSE '' END AS genres,
  CASE WHEN p_partkey % 5 <> 0 THEN p_brand ELSE '' END AS directors, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS runtime, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey ELSE 0 END AS num_mflix_comments, CASE WHEN p_partkey % 7 <> 0 THEN round(p_retailprice, 2) ELSE 0 END AS imdb_rating, p_partkey * 3 AS imdb_votes, p_size AS award_wins, 'movie' AS type FROM part""",
    "scanned_comments": """SELECT 'comment_' || k AS id, text, 'comments' AS source, role AS name, role || '@example.com' AS email, conv_id::VARCHAR AS movie_id, (k * 7)::VARCHAR AS date FROM (SELECT *, conv_id * 1000 + turn AS k FROM conversations) WHERE k % 5 <> 0 AND regexp_matches(text, '[^ \\t\\n\\x0B\\f\\r]')""",
    "scanned_queries": "SELECT 'q' || item_id AS query_id, text AS query, 2 AS n_relevant, (item_id + 1)::VARCHAR AS second FROM benchmark",
    "scanned_truth": f"WITH {CHUNKS_SQL} SELECT 'first' AS \"old\", version AS \"new\", count(*) AS added, 0 AS deleted, count(DISTINCT document_name) AS modified, count(*) AS total FROM cv GROUP BY version",
}
