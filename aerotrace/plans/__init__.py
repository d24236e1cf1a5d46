"""Fixture views, the query registry and the flagship plan."""
