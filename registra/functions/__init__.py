"""Column types, sums and key rendering."""
