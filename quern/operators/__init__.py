"""Operators over DataFrames: comparing, aligning, scoring, ingesting, documents, tables."""
