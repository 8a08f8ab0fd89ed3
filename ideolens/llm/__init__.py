"""Operators for large training corpora (text mixing, cleaning, deduplication and scoring).

Nothing else in the library imports this subpackage.  Every operator takes DataFrames
with at least the columns it names (more columns are ignored, whatever their names) and
returns a DataFrame; ``queries.py`` registers one query per operator.
"""
