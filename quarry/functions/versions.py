"""Versions, their dates, and what file names say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Release dates (fixed values).
CALENDAR = (
    ("v5.2.3", "2022-11-22"), ("v5.3.1", "2023-07-26"), ("v5.3.2", "2023-09-14"), ("v5.3.3", "2024-02-20"), ("v5.3.4", "2025-06-01"), ("v5.3.5", "2025-06-08"),
    ("v2.4.7", "2020-09-12"), ("v3.3.4", "2023-12-01"), ("v3.4.4", "2024-10-20"), ("v3.5.3", "2024-09-25"), ("v3.5.4", "2024-12-18"), ("v3.5.5", "2025-03-01"),
)
EPOCH = "1970-01-01"
#: Pairs that are evaluated (fixed values).
PAIRS = (
    ("v5.2.3", "v5.3.1"), ("v5.3.1", "v5.3.2"), ("v5.3.2", "v5.3.3"), ("v5.3.3", "v5.3.4"), ("v5.3.4", "v5.3.5"),
    ("v2.4.7", "v3.3.4"), ("v3.3.4", "v3.4.4"), ("v3.4.4", "v3.5.3"), ("v3.5.3", "v3.5.4"), ("v3.5.4", "v3.5.5"),
)


def calendar(spark: SparkSession) -> DataFrame:
    """(version, version_date)."""
    return spark.createDataFrame(CALENDAR, "version string, version_date string").withColumn("version_date", F.col("version_date").cast("date"))


def version_date(version: Column) -> Column:
    """By the calendar; unknown versions have the epoch's date. The calendar is a dozen literals, so no join is needed."""
    known = F.create_map(*(F.lit(x) for pair in CALENDAR for x in pair))
    return F.coalesce(F.get(F.array(known[version]), F.lit(0)), F.lit(EPOCH)).cast("date")


def from_file_name(name: Column) -> Column:
    """``v`` and the first x.y.z of a file name, else ``unknown``."""
    found = F.regexp_extract(name, r"v?(\d+\.\d+\.\d+)", 1)
    return F.when(found == "", "unknown").otherwise(F.concat(F.lit("v"), found))


def from_pdf_name(name: Column) -> Column:
    """As from_file_name, the third part being optional, else ``v1.0.0``."""
    found = F.regexp_extract(name, r"v?(\d+\.\d+(?:\.\d+)?)", 1)
    return F.when(found == "", "v1.0.0").otherwise(F.concat(F.lit("v"), found))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def pdf_document_name(name: Column) -> Column:
    """The stem without versions, with blanks for underscores and hyphens; the stem if nothing is left."""
    base = stem(name)
    plain = F.trim(F.regexp_replace(F.translate(F.regexp_replace(base, r"v?\d+\.\d+(?:\.\d+)?", ""), "_-", "  "), r"\s+", " "))
    return F.when(plain == "", base).otherwise(plain)


def markdown_document_name(name: Column) -> Column:
    return F.trim(F.replace(F.translate(stem(name), "_", " "), F.lit("Release "), F.lit("")))


def normalised_name(name: Column) -> Column:
    """Lower case, without a version at the start."""
    return F.lower(F.trim(F.regexp_replace(name, r"^v[\d.]+\s*[~\-–—]?\s*", "")))


def markdown_chunk_id(file: Column, version: Column, index: Column) -> Column:
    return F.concat(file, F.lit("__"), version, F.lit("__chunk_"), index.cast("string"))


def pdf_chunk_id(file: Column, version: Column, page: Column, index: Column) -> Column:
    return F.concat(file, F.lit("__"), version, F.lit("_p"), page.cast("string"), F.lit("_c"), index.cast("string"))
