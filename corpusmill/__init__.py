"""Corpus analytics on PySpark: every operation is a function from DataFrames to DataFrames."""
