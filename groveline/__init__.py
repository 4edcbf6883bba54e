"""Groveline: vector, property and group analytics as PySpark DataFrame plans."""
