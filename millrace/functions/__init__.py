"""Column functions and path lookups."""
