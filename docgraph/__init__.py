"""A document-to-graph analytics engine on Spark DataFrames."""
