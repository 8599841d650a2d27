"""Relational operators on fragments, alignments and positions."""
