"""Column functions: plain Spark expressions, no Python in the row path."""
