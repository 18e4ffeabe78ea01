"""Batch jobs on Spark DataFrames for building and judging retrieval-backed assistants."""
