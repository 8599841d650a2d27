"""Training-data operators: archives, filters, near duplicates, tokens and chat text.

Nothing outside this package imports it.
"""
