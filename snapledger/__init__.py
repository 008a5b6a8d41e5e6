"""Analytics over periodic snapshots of nested JSON sources, on Spark DataFrames."""
