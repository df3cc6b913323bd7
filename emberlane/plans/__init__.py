"""Queries: operators bound to tables, each with its SQL."""
