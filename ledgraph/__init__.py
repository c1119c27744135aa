"""Leakage-safe jobs on time-stamped transaction graphs, and training-data operators, on Spark."""
