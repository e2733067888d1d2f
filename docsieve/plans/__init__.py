"""Syntax tree, grammar and rewrites of the query language."""
