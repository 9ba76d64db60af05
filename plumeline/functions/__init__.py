"""Column expressions: map projections, grid keys, coordinates, times and safe arithmetic."""
