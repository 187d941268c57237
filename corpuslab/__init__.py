"""A text-corpus curation and analytics engine on Spark DataFrames."""
