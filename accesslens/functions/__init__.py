"""Column builders: expressions only, no actions, no UDFs."""
