"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage, and the repository works
without it.  Every operator is a function of DataFrames; ``queries`` holds the
thin queries that derive digest columns from the operators' outputs.
"""
