"""Sources of factweave."""
