"""Typed single-table plans: models, expressions, queries, named SQL and table definitions."""
