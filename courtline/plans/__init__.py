"""Queries bound to the given tables, each with its SQL counterpart."""
