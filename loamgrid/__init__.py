"""Spatial mapping analytics on PySpark: samples, covariate cells, areas, models and uncertainty."""
