"""Column functions: row-local expressions, no shuffle, no Python workers."""
