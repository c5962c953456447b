"""Operators for very large training-data tables; nothing else in the library imports this."""
