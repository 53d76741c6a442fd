"""Analytical operators, one module per subject."""
