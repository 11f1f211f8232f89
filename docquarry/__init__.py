"""A document-analytics engine written for Spark DataFrames."""
