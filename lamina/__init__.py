"""Spark-first analytics over voxel rasters, region graphs and study metadata."""
