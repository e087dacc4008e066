"""Training-data operators: quality, duplication, leakage, scoring, tokens and packing.

Nothing else in the library imports this subpackage; ``registry`` holds its
queries and their SQL.
"""
