"""Operators on conversations, names, texts and their use as training data."""
