"""Operators on tables of segmented objects: each takes and returns lazy DataFrames."""
