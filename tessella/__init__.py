"""Tessella: detection-dataset preparation over georeferenced imagery on PySpark."""
