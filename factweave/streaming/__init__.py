"""Streaming of factweave."""
