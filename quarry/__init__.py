"""Quarry: catalogue, full-text, vector and corpus queries as Spark DataFrames."""
