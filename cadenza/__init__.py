"""Catalog cleaning, linking, merging and analysis on Spark DataFrames."""
