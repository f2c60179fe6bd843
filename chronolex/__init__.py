"""chronolex: evidence retrieval and temporal text analytics on Spark DataFrames."""
