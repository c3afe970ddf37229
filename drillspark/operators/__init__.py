"""Queries over DataFrames: each function takes frames and returns a frame or a predicate."""
