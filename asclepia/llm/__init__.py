"""Operators for training-data pipelines, one module each.

Nothing outside this subpackage imports it; the query registry is in :mod:`asclepia.llm.queries`.
"""
