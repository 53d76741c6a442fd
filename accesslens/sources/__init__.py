"""Readers and writers of the request table and its lookup tables."""
