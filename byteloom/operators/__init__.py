"""Operators over DataFrames built from the column functions."""
