"""Operators that prepare and score training text. Nothing else in the library imports this package."""
