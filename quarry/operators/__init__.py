"""Operators: retrieval, relevance and metrics, change detection, ingestion, answers."""
