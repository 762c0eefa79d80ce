"""Functions of factweave."""
