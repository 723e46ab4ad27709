"""Operators for text that trains language models. Nothing else in the library imports this package."""
