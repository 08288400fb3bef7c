"""Operators of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Every operator takes DataFrames
and column names; the thin ``op<N>_<name>`` queries that bind an operator to a
table live in :mod:`rhoscope.llm.queries`.
"""
