"""Page-layer analytics on Spark: document pages as DataFrames."""
