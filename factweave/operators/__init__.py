"""Operators of factweave."""
