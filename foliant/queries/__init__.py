"""Queries over the driver's tables, one per operator, each with the SQL that gives the same rows."""
