"""Posting tracking on Spark: read, normalize, track, search, observe and plan."""
