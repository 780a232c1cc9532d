"""Operators for preparing large text corpora.

Nothing else in the package imports this subpackage.  Every operator takes a
DataFrame and returns a narrow DataFrame keyed by the id column, so further
columns of the input, whatever they are called, can never clash with its own.
"""
