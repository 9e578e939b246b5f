"""Repositories, specifications and units of work, planned as Spark DataFrames."""
