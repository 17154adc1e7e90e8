"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; the thin contract queries over them are in ``queries.py``
and their DuckDB counterparts in ``oracles.py``.
"""
