"""Content-bank analytics on Spark DataFrames."""
