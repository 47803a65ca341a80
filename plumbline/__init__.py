"""Plumbline: reproducible dataset checks, splits, metrics and decisions on Spark DataFrames."""
