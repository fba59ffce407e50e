"""segmill: analytics over immutable search segments, on Spark DataFrames."""
