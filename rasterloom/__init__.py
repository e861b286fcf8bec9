"""Raster analytics on Spark: images, chunks and animations as DataFrames."""

__all__ = ["operators", "sources", "functions", "plans", "streaming"]
