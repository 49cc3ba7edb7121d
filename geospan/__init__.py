"""PySpark-native geospatial analytics: rasters, vectors, points, graphs and radar data as DataFrames."""

__version__ = "0.1.0"
