"""Composed pages and the registry of named queries with their oracles."""
