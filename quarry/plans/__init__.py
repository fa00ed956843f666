"""Queries over the standard tables, each with its SQL where SQL can say it."""
