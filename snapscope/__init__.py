"""Snapshot analytics on Spark: compare, search, track and profile dated copies of the same data."""
