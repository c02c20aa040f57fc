"""Event-window time-series analytics and forecast verification on Spark DataFrames."""
