"""Reusable intermediate tables and the multi-result views built on them."""
