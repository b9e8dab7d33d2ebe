"""Operators over DataFrames; every one takes its column names."""
