"""Training-data operators: filters, scorers, near-duplicate search, tokenising and packing.

Nothing outside this subpackage imports it. ``queries.py`` holds the registered queries and their SQL.
"""
