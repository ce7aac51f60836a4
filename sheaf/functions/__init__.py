"""Column expressions that parse and format values."""
