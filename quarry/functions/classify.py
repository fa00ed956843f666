"""Query and failure classes as CASE expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import contains_any

# Word lists and patterns (fixed values).
VERSION = r"\bv?\d+\.\d+(?:\.\d+)?\b"
COMPARISON = ("compare", "comparison", "vs", "versus", "difference between", "differences between", "differ", "between versions", "which version", "better than", "worse than", "over version")
CROSS_VERSION = ("across versions", "across all versions", "throughout versions", "evolution of", "history of", "over time", "multiple versions", "all versions", "each version", "version to version")
VERSION_WORDS = ("release notes", "changelog", "patch notes", "release", "what is in version", "what was in version")
CHANGE_VERBS = ("introduced", "modified", "changed", "added", "fixed", "removed", "deprecated", "updated", "improved", "enhanced", "what changed", "new in", "added in", "fixed in")
FEATURE_WORDS = ("what changed", "what is new", "what was added", "recently introduced", "latest changes", "latest update", "update to", "upgrade", "migration")
ANCHORS = ("version", "release", "update", "patch", "changelog", "introduced", "modified", "changed", "new in", "fixed in")
# Notes and texts of reports (fixed values).
NOTES = {
    "none": "Retriever returned 0 chunks — no matching content in the KB.",
    "answer": "Retrieved the correct version chunk but the LLM generated an incorrect answer.",
    "version": "Expected {expected} but retrieved: {retrieved}.",
    "few": "Query lacks a version anchor; only {n}/{k} chunks returned.",
    "sparse": "Only {n}/{k} chunks retrieved — limited KB coverage for this version.",
    "ambiguous": "Query lacks a version anchor or specific topic keyword.",
    "chunk": "Version matched and chunks returned, but content may be off-topic for the query.",
}
EFFICIENCY = (
    "Highly efficient — system re-embeds <20% of chunks on update",
    "Moderate efficiency — roughly half of chunks re-embedded",
    "Low efficiency — majority of chunks re-embedded (expected for first ingest)",
)
CATEGORIES = ("Version-Specific Query", "Comparison Query", "Feature/Change Query", "General Fact Query", "Cross-Version Query")


def classify_query(text: Column) -> Column:
    """One of CATEGORIES; the first that fits in the order comparison, cross-version, version, change, general."""
    q = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(q.rlike(f"{VERSION}.*{VERSION}") | contains_any(q, COMPARISON), "Comparison Query")
        .when(contains_any(q, CROSS_VERSION), "Cross-Version Query")
        .when(q.rlike(VERSION) | contains_any(q, VERSION_WORDS), "Version-Specific Query")
        .when(contains_any(q, CHANGE_VERBS + FEATURE_WORDS), "Feature/Change Query")
        .otherwise("General Fact Query")
    )


def is_ambiguous(text: Column) -> Column:
    """Neither a version nor an anchor word."""
    q = F.lower(F.coalesce(text, F.lit("")))
    return ~(q.rlike(VERSION) | contains_any(q, ANCHORS))


def version_matches(expected: Column, retrieved: Column) -> Column:
    """Whether expected is among the comma-separated retrieved versions."""
    there = F.array_contains(F.transform(F.split(retrieved, ","), lambda v: F.trim(v)), F.trim(expected))
    return F.when(F.coalesce(retrieved, F.lit("")).isin("", "none"), F.lit(False)).otherwise(F.coalesce(there, F.lit(False)))


def classify_failure(query: Column, expected: Column, retrieved: Column, chunks: Column, leak: Column, wrong_answer: Column | None = None, threshold: int = 5) -> Column:
    """struct<failure_category, notes>."""
    wrong = F.lit(False) if wrong_answer is None else F.coalesce(wrong_answer, F.lit(False))
    matches, ambiguous, sparse = version_matches(expected, retrieved), is_ambiguous(query), chunks < threshold
    count = chunks.cast("string")
    values = {"{expected}": expected, "{retrieved}": retrieved, "{n}": count, "{k}": F.lit(str(threshold))}

    def said(category: str, note: str) -> Column:
        parts = [values.get(x, F.lit(x)) for x in re.split(r"(\{\w+\})", NOTES[note]) if x]
        return F.struct(F.lit(category).alias("failure_category"), F.concat(*parts).alias("notes"))

    return (
        F.when(chunks == 0, said("No Relevant Chunk Retrieved", "none"))
        .when(wrong & matches, said("Retrieval Correct but LLM Answer Incorrect", "answer"))
        .when(leak | ~matches, said("Wrong Version Retrieved", "version"))
        .when(sparse & ambiguous, said("Ambiguous Query", "few"))
        .when(sparse, said("Sparse Coverage", "sparse"))
        .when(ambiguous, said("Ambiguous Query", "ambiguous"))
        .otherwise(said("Wrong Chunk Retrieved", "chunk"))
    )


def efficiency_text(ratio: Column) -> Column:
    return F.when(ratio < 0.2, EFFICIENCY[0]).when(ratio < 0.5, EFFICIENCY[1]).otherwise(EFFICIENCY[2])
