"""Compliance analytics on Spark DataFrames."""
