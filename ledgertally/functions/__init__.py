"""Column expressions: validity checks, exact sums, month labels, text rendering."""
