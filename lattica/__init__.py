"""Relational databases to model-ready training data, on Spark DataFrames."""
