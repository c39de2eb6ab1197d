"""Column functions: dates, projections, functions of time."""
