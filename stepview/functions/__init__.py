"""Column expressions: path parsing, natural order, labels."""
