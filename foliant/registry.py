"""The library's queries by name, and the SQL that gives the same rows."""

from foliant.queries import catalog, checks, extract, layout, metrics, plans, rules, text, windows, work  # noqa: F401
from foliant.queries.base import QUERIES, SQL  # noqa: F401
