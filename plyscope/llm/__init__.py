"""Operators for large text corpora.

Every numbered operator lives in its own module and takes and returns
DataFrames; ``queries`` holds the thin queries over the driver's tables.
Nothing else in the library imports this subpackage.
"""
