"""A Lucene-style search and log analytics engine on Spark DataFrames."""
