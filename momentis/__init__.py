"""Moment analytics over irregular event time-series, declared with the Spark DataFrame and SQL APIs."""
