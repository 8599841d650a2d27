"""Sequence functions as Spark columns, and scoring tables."""
