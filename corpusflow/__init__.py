"""Curating, checking and scoring paired report corpora with Spark DataFrames."""
