"""Operators of a large training-data pipeline, each a Spark job over DataFrames.

Nothing else in the package imports this subpackage.
"""
