"""Whole flows on given tables, and the catalog of queries with their SQL counterparts."""
