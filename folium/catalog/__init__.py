"""Registered queries by subject; each module has a list of (name, query, SQL or None)."""
