"""Queries: operators bound to tables, and their SQL equivalents."""
