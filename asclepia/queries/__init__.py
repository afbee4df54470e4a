"""Registered queries: each operator over the test tables, with the same in SQL."""

from __future__ import annotations

from asclepia.queries import language, relational, scalars

QUERIES = scalars.QUERIES | relational.QUERIES | language.QUERIES
ORACLES = scalars.ORACLES | relational.ORACLES | language.ORACLES
