"""Weighted prefix search and range-maximum queries as Spark DataFrame plans."""
