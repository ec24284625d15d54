"""Column functions and small helpers on names and paths."""
