"""Raw inputs as DataFrames with declared schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import versions as V
from quarry.functions.text import chunk_markdown, chunk_page, section_header

CHUNKS = "chunk_id string, document_name string, version string, version_date date, page_number int, section_header string, source_file string, chunk_index int, checksum string, text string"

# Extended JSON: plain values come as strings, {"$oid": ..}, {"$date": ..} and the like as JSON text of the object.
MOVIE = (
    "_id string, title string, genres array<string>, cast array<string>, directors array<string>, writers array<string>, countries array<string>, languages array<string>, year string, runtime string, rated string, type string, "
    "awards struct<text:string,wins:string,nominations:string>, imdb struct<rating:string,votes:string>, tomatoes struct<viewer:struct<rating:string,meter:string>>, num_mflix_comments string"
)
COMMENT = "_id string, name string, email string, movie_id string, date string, text string"


def file_name() -> Column:
    """The name of the file that a row comes from; paths are percent-encoded."""
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, text): one row per *.md file, decoded as UTF-8 with replacement."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    return files.select(file_name().alias("source_file"), F.col("value").alias("text"))


def markdown_chunks(files: DataFrame, limit: int = 800) -> DataFrame:
    """Rows of CHUNKS from (source_file, text); indices count what is left after short chunks are dropped."""
    return chunk_columns(files.select("source_file", F.posexplode(chunk_markdown(F.col("text"), limit)).alias("chunk_index", "text"))).select(*_CHUNK)


_CHUNK = ("chunk_id", "document_name", "version", "version_date", "page_number", "section_header", "source_file", "chunk_index", "checksum", "text")


def chunk_columns(chunks: DataFrame) -> DataFrame:
    """The columns of CHUNKS from (source_file, chunk_index, text), and what else there is. Where a checksum is given, the text is not needed."""
    checksum = F.col("checksum") if "checksum" in chunks.columns else F.sha2("text", 256)
    rows = chunks.withColumn("version", V.from_file_name(F.col("source_file")))
    return rows.select(
        V.markdown_chunk_id(F.col("source_file"), F.col("version"), F.col("chunk_index")).alias("chunk_id"), V.markdown_document_name(F.col("source_file")).alias("document_name"), "version", V.version_date(F.col("version")).alias("version_date"),
        F.lit(1).alias("page_number"), F.concat(F.lit("Section "), (F.col("chunk_index") + 1).cast("string")).alias("section_header"), "source_file", "chunk_index", checksum.alias("checksum"), *(["text"] if "text" in chunks.columns else []),
        *(c for c in chunks.columns if c not in _CHUNK),
    )


def pdf_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(source_file, page, text): pages that are not blank, from 1. Unreadable files give nothing. Needs the pypdf package."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the pypdf package") from e

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        from pypdf import PdfReader

        for f in frames:
            for name, content in zip(f["name"], f["content"], strict=True):
                try:
                    pages = [p.extract_text() or "" for p in PdfReader(io.BytesIO(bytes(content))).pages]
                except Exception:
                    pages = []
                rows = [(name, i, t) for i, t in enumerate(pages, 1) if t.strip()]
                if rows:
                    yield pd.DataFrame(rows, columns=["source_file", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select(file_name().alias("name"), "content").mapInPandas(run, "source_file string, page int, text string")


def page_chunks(pages: DataFrame, limit: int = 800) -> DataFrame:
    """Rows of CHUNKS from (source_file, page, text). Chunks do not cross pages; their index counts over the file. The version follows
    the rule for such files, its date the rule for file names in general."""
    cut = pages.select("source_file", "page", F.posexplode(chunk_page(F.col("text"), limit)).alias("at", "text"))
    rows = cut.withColumn("chunk_index", F.row_number().over(Window.partitionBy("source_file").orderBy("page", "at")) - 1).withColumn("version", V.from_pdf_name(F.col("source_file")))
    return rows.select(
        V.pdf_chunk_id(F.col("source_file"), F.col("version"), F.col("page"), F.col("chunk_index")).alias("chunk_id"), V.pdf_document_name(F.col("source_file")).alias("document_name"), "version", V.version_date(V.from_file_name(F.col("source_file"))).alias("version_date"),
        F.col("page").alias("page_number"), section_header(F.col("text"), F.col("page")).alias("section_header"), "source_file", "chunk_index", F.sha2("text", 256).alias("checksum"), "text",
    )


def sqlite_records(spark: SparkSession, path: str, table: str = "chunk_versions", version: str | None = None) -> DataFrame:
    """Records of chunks from SQLite files, of one version or of all: to bring an existing database into a store. Each file is read whole, by
    one task, wherever it lies; columns that it lacks are null."""
    names = [c.split()[0] for c in SQLITE.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for f in frames:
            for content in f["content"]:
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                there = {r[1] for r in db.execute(f'PRAGMA table_info("{table}")')}
                found = ", ".join(f'"{n}"' if n in there else f'NULL AS "{n}"' for n in names)
                rows = db.execute(f'SELECT {found} FROM "{table}"' + (" WHERE version = ?" if version else ""), (version,) if version else ())
                while part := rows.fetchmany(10_000):
                    yield pd.DataFrame(part, columns=names).astype(object)
                db.close()

    read = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SQLITE)
    dated = {"version_date": "date", "ingested_at": "timestamp"}
    return read.select(*(F.col(n).try_cast(dated[n]).alias(n) if n in dated else F.col(n) for n in names))


SQLITE = "chunk_id string, document_name string, version string, version_date string, page_number int, section_header string, source_file string, chunk_index int, checksum string, changed_flag int, ingested_at string"


def scalar(value: Column) -> Column:
    """Extended JSON as plain text: null is empty, objects give their $oid or $date (or its $numberLong), $binary gives [binary]."""
    json = lambda path: F.get_json_object(value, path)
    inner = F.coalesce(json("$['$oid']"), json("$['$date']['$numberLong']"), json("$['$date']"), F.when(json("$['$binary']").isNotNull(), "[binary]"))
    return F.when(value.startswith("{"), F.coalesce(inner, value)).otherwise(F.coalesce(value, F.lit("")))


def number(value: Column, kind: str) -> Column:
    return F.coalesce(scalar(value).try_cast(kind), F.lit(0).cast(kind))


def movie_text(title: str = "title") -> Column:
    """Labelled parts joined by ``. ``, empty ones left out; the first six of the cast, four writers without their roles."""
    part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label + ": "), c))
    listed = lambda label, c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(label + ": "), F.array_join(c, ", ")))
    writers = F.transform(F.slice("writers", 1, 4), lambda w: F.trim(F.get(F.split(w, r"\("), F.lit(0))))
    year = F.when(~F.col("year").isin("0", ""), F.col("year"))
    text = F.concat_ws(
        ". ", part("Title", F.col(title)), listed("Genres", F.col("genres")), listed("Cast", F.slice("cast", 1, 6)), listed("Directors", F.col("directors")), listed("Writers", writers),
        listed("Countries", F.col("countries")), listed("Languages", F.col("languages")), part("Year", year), part("Awards", F.col("awards.text")),
    )
    return F.when(text == "", "unknown").otherwise(text)


def movies(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, source, title, year, ...): a JSON array of movie documents, one row each."""
    raw = json_records(spark, path, MOVIE)
    joined = lambda c: F.coalesce(F.array_join(c, ", "), F.lit("")).alias(c)
    whole = lambda c: F.coalesce(F.when(F.col(c).rlike(r"^-?\d+$"), F.col(c).try_cast("int")), F.lit(0)).alias(c)
    return raw.select(
        F.concat(F.lit("movie_"), scalar(F.col("_id"))).alias("id"), movie_text().alias("text"), F.lit("movies").alias("source"), scalar(F.col("title")).alias("title"), whole("year"), joined("genres"), joined("directors"), joined("cast"), joined("countries"), joined("languages"),
        scalar(F.col("rated")).alias("rated"), whole("runtime"), number(F.col("num_mflix_comments"), "int").alias("num_mflix_comments"), number(F.col("imdb.rating"), "double").alias("imdb_rating"), number(F.col("imdb.votes"), "int").alias("imdb_votes"),
        number(F.col("tomatoes.viewer.rating"), "double").alias("viewer_rating"), number(F.col("tomatoes.viewer.meter"), "int").alias("viewer_meter"), number(F.col("awards.wins"), "int").alias("award_wins"), number(F.col("awards.nominations"), "int").alias("award_nominations"),
        F.coalesce("type", F.lit("movie")).alias("type"),
    )


def comments(spark: SparkSession, path: str) -> DataFrame:
    """(id, text, source, name, email, movie_id, date); comments of white space alone are dropped."""
    raw = json_records(spark, path, COMMENT).where(F.col("text").rlike(r"\S"))
    plain = [scalar(F.col(c)).alias(c) for c in ("name", "email", "movie_id", "date")]
    return raw.select(F.concat(F.lit("comment_"), scalar(F.col("_id"))).alias("id"), "text", F.lit("comments").alias("source"), *plain)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records, such as query sets. The file is one line to Spark, up to a character that stands in no JSON: then it is parsed
    from memory. With multiLine, Spark goes back to the file for each object or number that is wanted as text."""
    return spark.read.schema(schema).json(path, lineSep="\x01")


def change_truth(spark: SparkSession, path: str) -> DataFrame:
    """(old, new, added, deleted, modified, total) of version pairs; a missing count is 0, of repeated pairs the last stands, a missing
    file is an empty table."""
    from pyspark.errors import AnalysisException

    names = {"added": "added_chunks_count", "deleted": "deleted_chunks_count", "modified": "modified_chunks_count", "total": "total_actual_changes"}
    schema = "version_pairs array<struct<old_version:string,new_version:string," + ",".join(f"{n}:int" for n in names.values()) + ">>"
    try:
        raw = spark.read.schema(schema).json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], "old string, new string, added int, deleted int, modified int, total int")
    rows = raw.select(F.posexplode("version_pairs").alias("at", "p"))
    last = rows.groupBy(F.col("p.old_version").alias("old"), F.col("p.new_version").alias("new")).agg(F.max_by("p", "at").alias("p"))
    return last.select("old", "new", *(F.coalesce(f"p.{n}", F.lit(0)).alias(k) for k, n in names.items()))
