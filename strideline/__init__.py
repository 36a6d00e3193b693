"""Activity time-series analytics on Spark."""
