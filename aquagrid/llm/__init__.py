"""Operators for building training text. Nothing else in the package imports this folder."""
