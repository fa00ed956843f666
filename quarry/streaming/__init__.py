"""Structured Streaming around the batch operators."""
