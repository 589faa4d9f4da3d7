"""Registered queries, with their SQL beside them."""
