"""Analytics and data mining on Spark DataFrames."""
