"""Analytics over versioned, content-addressed datasets, on Spark DataFrames."""
