"""Operators for preparing large text corpora as training data.

Nothing else in the library imports this subpackage. Every operator takes
DataFrames and column names and returns a DataFrame; only the columns an
operator reads are selected from its input, so further columns (whatever
their names) never clash with what it adds.
"""
