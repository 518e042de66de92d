"""Relational operators on rasters, tiles, labels, features and metrics."""
