"""Spectral-imaging jobs as Spark DataFrames."""
