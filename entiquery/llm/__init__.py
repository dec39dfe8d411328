"""Operators for large-scale training-data pipelines, on DataFrames.

Nothing outside this subpackage imports it; its queries are in :mod:`entiquery.llm.queries`.
"""
