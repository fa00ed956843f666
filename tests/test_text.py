import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors, versions


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "given,want",
    [
        ("", []), (None, []), ("a" * 20, []), ("a" * 21, ["a" * 21]), ("a" * 30 + "\r\n\r\n" + "b" * 30, ["a" * 30 + "\n\n" + "b" * 30]), ("a" * 30 + "\r\r" + "b" * 30, ["a" * 30 + "\n\n" + "b" * 30]),
        ("a" * 399 + "\n\n" + "b" * 399, ["a" * 399 + "\n\n" + "b" * 399]), ("a" * 400 + "\n\n" + "b" * 399, ["a" * 400, "b" * 399]),
        ("x" * 900, ["x" * 900]),  # one long sentence stays whole
        ("s" * 500 + ". " + "t" * 500 + "." + "\n\nshort tail", ["s" * 500 + ".", "t" * 500 + ".\n\nshort tail"]),  # the last segment stays open
        ("head" * 10 + "\n\n" + "s" * 500 + ". " + "t" * 500 + ".", ["head" * 10, "s" * 500 + ".", "t" * 500 + "."]), (" \n\n  padded paragraph here, long enough  \n\n\n", ["padded paragraph here, long enough"]),
        ("One two three. Four five six! Seven eight nine? " * 30, None),
    ],
)
def test_markdown_chunks(spark, given, want):
    got = one(spark, given, T.chunk_markdown)
    if want is None:
        assert all(20 < len(c) <= 800 for c in got) and " ".join(got) == given.strip()
    else:
        assert got == want


def test_page_chunks(spark):
    assert one(spark, "tiny\n\n" + "b" * 900 + "\n\nc", T.chunk_page) == ["tiny", "b" * 900, "c"]
    assert one(spark, "a\n\nb", T.chunk_page) == ["a\n\nb"] and one(spark, " ", T.chunk_page) == []


@pytest.mark.parametrize("given,want", [("# Heading\nx", "Heading"), ("INTRO\nx", "INTRO"), ("First Title Here\nx", "First Title Here"), ("note:\nx", "note"), ("plain words only\nmore of them", "Section Page 7"), ("\n\nplain first\n## Second", "Second"), ("L" * 60, "Section Page 7")])
def test_section_header(spark, given, want):
    assert one(spark, given, lambda c: T.section_header(c, F.lit(7))) == want


def test_words(spark):
    assert one(spark, "  The the  CAT.\tsat ", T.lower_words) == ["the", "the", "cat.", "sat"]
    assert one(spark, "Über naïve cafe cafe x_1a abcd 12345 abc", T.content_words) == ["cafe", "abcd", "12345"]
    assert one(spark, "based film words", lambda c: T.content_words(c, ("based", "film"))) == ["words"]
    assert one(spark, None, T.content_words) == []


def test_typos_are_repeatable_edits(spark):
    words = "alpha beta gamma delta epsilon"
    bent = one(spark, words, lambda c: T.typos(c, F.lit(3)))
    assert bent == one(spark, words, lambda c: T.typos(c, F.lit(3))) != words
    changed = [(a, b) for a, b in zip(words.split(), bent.split(), strict=True) if a != b]
    assert 1 <= len(changed) <= 2 and all(abs(len(a) - len(b)) <= 1 and a[0] == b[0] for a, b in changed)
    assert one(spark, "alone", lambda c: T.typos(c, F.lit(1))) == "alone" and one(spark, "a b c", lambda c: T.typos(c, F.lit(1))) == "a b c"


def test_names_and_dates(spark):
    name = "assert nodejs 18.20.8.md"
    assert one(spark, name, versions.from_file_name) == "v18.20.8" and one(spark, "x 1.2.md", versions.from_file_name) == "unknown"
    assert one(spark, "guide_1.2.pdf", versions.from_pdf_name) == "v1.2" and one(spark, "guide.pdf", versions.from_pdf_name) == "v1.0.0"
    assert one(spark, "My_guide-v3.5.4.pdf", versions.pdf_document_name) == "My guide" and one(spark, "1.2.pdf", versions.pdf_document_name) == "1.2"
    assert one(spark, "Release Spark_3.5.4.md", versions.markdown_document_name) == "Spark 3.5.4"
    assert one(spark, "v5.3.2 ~ Docs 1.0", versions.normalised_name) == "docs 1.0"
    assert str(one(spark, "v3.4.4", versions.version_date)) == "2024-10-20" and str(one(spark, "v9", versions.version_date)) == "1970-01-01"
    assert one(spark, None, versions.version_date).year == 1970


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.squared_l2(F.col("a"), F.col("b")).alias("l")).collect()
    assert [round(r.c, 6) for r in rows] == [0.96, 0.0] and [r.l for r in rows] == [2.0, 1.0]


def test_digest(spark):
    assert one(spark, "abc", lambda c: F.sha2(c, 256)) == hashlib.sha256(b"abc").hexdigest()
