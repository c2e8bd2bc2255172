"""Operators that prepare text corpora for model training.

Each module holds one operator with a general DataFrame interface; ``queries``
binds them to the given tables.  Nothing outside this package imports it.
"""
