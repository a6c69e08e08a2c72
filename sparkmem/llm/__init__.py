"""Training-data operators: sharding, near-duplicates, token counts, formatting, decontamination, scoring.

Nothing else in the library imports this subpackage; ``queries`` holds the registered
queries and their SQL.
"""
