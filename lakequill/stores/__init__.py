"""Stored tables with versions, and the indexes that are kept in them."""
