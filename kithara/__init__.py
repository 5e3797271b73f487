"""kithara: repertoire-comparison analytics on Spark DataFrames."""
