"""Ontolith: typed object-graph analytics on Spark DataFrames."""
