"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries`` maps query names to
callables, ``oracle`` holds the DuckDB text of those that SQL can express.
"""
