"""Training-data operators: deduplication, scoring, sampling, tokenising, formatting.

Each module holds one operator with its general interface; ``queries`` holds the
thin registered queries and their SQL.  Nothing outside this package imports it.
"""
