"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from gemello.llm import queries

QUERIES = queries.QUERIES
ORACLES = queries.ORACLES
