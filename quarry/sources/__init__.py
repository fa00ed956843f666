"""Readers of raw documents and records, and the snapshot store."""
