"""Typed-table analytics on Spark DataFrames."""
