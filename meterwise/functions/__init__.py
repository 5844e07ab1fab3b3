"""Column-level functions (pure Spark expressions, no UDFs)."""
