"""Sphere-grid analytics on PySpark DataFrames."""
