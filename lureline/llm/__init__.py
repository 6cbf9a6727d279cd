"""Operators of a training-data pipeline (nothing else in the library imports this subpackage).

Every module holds one operator with a general interface; ``queries`` holds the thin registered
queries, ``oracles`` their SQL where SQL can express them.
"""
