"""Raster pyramid analytics on Spark: images as DataFrames of levels, tiles and cells."""

__version__ = "0.1.0"
