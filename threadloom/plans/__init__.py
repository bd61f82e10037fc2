"""Queries: operators applied to the test tables, with their SQL."""
