"""Registered queries: operators applied to the given tables, with their SQL counterparts."""
