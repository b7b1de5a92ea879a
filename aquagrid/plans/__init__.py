"""Whole jobs composed of operators. Each is one plan over all years and regions."""
