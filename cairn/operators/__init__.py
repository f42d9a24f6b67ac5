"""Relational operators over the canonical key-value, range and namespace tables."""
