"""Column functions built from native expressions only."""
