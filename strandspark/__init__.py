"""Consensus analytics over noisy sequence fragments, on Spark."""
