"""Operators of the commerce engine."""
