"""Whole programs: assembly, reports, contamination."""
