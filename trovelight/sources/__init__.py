"""Reading files and writing tables."""
