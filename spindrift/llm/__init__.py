"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage. Every operator is a function from DataFrames to a
DataFrame; the thin ``opN_*`` queries in :mod:`spindrift.llm.queries` derive the digest columns from them.
"""
