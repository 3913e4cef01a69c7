"""Multispectral raster analytics as Spark DataFrame operators."""
