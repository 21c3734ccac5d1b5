"""Relational operators with defined semantics: mutations, ids, changelogs, health folds, idempotency, checks."""
