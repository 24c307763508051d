"""octarine: point-cloud geometry analytics on Spark DataFrames."""
