"""Positional predicates and search over DataFrames."""
