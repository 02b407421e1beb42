"""Column expressions: colours, geometry, rules over text."""
