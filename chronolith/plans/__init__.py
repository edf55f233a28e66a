"""Queries over the driver's tables, and the SQL of the same results."""

from . import answers, landed, more, pages, queries, records, served, words  # noqa: F401  all register
