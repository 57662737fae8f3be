"""Composed plans: the mart build, the query registry and its SQL oracles."""
