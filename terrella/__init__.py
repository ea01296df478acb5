"""Spatial analytics on PySpark DataFrames."""
