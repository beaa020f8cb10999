"""Column building blocks: pure expressions, no actions, no UDFs."""
