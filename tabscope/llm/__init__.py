"""Operators of a training-data pipeline over whole corpora.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; ``queries.py`` registers one thin query per operator.
"""
