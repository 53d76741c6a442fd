"""Query and oracle registry: every operator on the given tables."""
