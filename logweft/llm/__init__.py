"""Operators for preparing large training-data corpora.

Nothing outside this package imports it.  Every operator takes and returns
DataFrames; `queries` holds the thin registered queries over the test tables.
"""
