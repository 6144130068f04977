"""geoskein: spatial accessibility analytics on Spark DataFrames."""
