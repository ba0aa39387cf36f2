"""Column builders: pure expressions, no actions and no Python UDFs."""
