"""Relational analytics over document collections and the reviewed records derived from them, on Spark."""
