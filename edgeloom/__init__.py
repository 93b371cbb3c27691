"""Temporal graph pattern matching on Spark DataFrames."""
