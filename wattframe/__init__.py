"""Electricity-market price analytics on Spark.

Every operator takes DataFrames and returns a DataFrame; nothing is computed
until the caller runs an action, except where a docstring says so (writers,
model fitting, and the size check of the exact vector search).
"""
