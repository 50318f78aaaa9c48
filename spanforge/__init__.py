"""A Spark library of interval, ranking and evaluation operators for timeline data."""
