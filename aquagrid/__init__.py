"""Gridded water-use analytics as plain PySpark DataFrame operators."""
