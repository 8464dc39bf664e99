"""Document forensics and training-corpus analytics on Spark DataFrames."""
