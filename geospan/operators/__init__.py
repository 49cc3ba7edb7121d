"""Raster, vector, network and point operators over DataFrames."""
