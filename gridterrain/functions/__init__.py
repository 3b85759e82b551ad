"""Column expressions: postcode text, names, numbers and colours."""
