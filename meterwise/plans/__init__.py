"""Registered queries (Spark) and their independent SQL oracles (DuckDB)."""
