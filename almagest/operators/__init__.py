"""Operators on panels, each DataFrame in, DataFrame out."""
