"""Column expressions: hexagonal grid, geodesy, names and clean-up."""
