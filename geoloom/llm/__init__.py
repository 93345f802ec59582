"""Operators for large-scale training-data pipelines.

Nothing outside this sub-package imports it.  Operators take and return
DataFrames; ``queries.py`` registers one query per operator.
"""
