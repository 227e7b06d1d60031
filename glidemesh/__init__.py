"""Landing-site conflation and terrain-reachability analytics on Spark DataFrames."""
