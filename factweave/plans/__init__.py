"""Plans of factweave."""
