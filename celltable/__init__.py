"""Spatial single-cell tables on Spark DataFrames."""
