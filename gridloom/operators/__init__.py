"""Operators on rasters, stacks, lines and profiles."""
