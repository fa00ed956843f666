"""The catalogue of queries and their SQL."""

from __future__ import annotations

from quarry.plans import changes, ingestion, reports, retrieval, scans


def queries() -> dict:
    return {**retrieval.QUERIES, **changes.QUERIES, **reports.QUERIES, **ingestion.QUERIES, **scans.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**retrieval.SQL, **changes.SQL, **reports.SQL, **ingestion.SQL, **scans.SQL}
