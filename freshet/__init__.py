"""Hydrologic analytics on PySpark."""
