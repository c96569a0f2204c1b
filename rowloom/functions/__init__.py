"""Column expressions: value rules, calculations, date variables, labels."""
