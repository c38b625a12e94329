"""Operators on text corpora for model training; nothing outside imports this package."""
