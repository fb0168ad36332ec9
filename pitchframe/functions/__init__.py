"""Column expressions for scoring and form."""
