"""Gridded, time-stamped measurements as Spark tables."""
