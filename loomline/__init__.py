"""Preference and rationale analytics on Spark DataFrames."""
