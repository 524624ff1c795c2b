"""Raster views over the driver tables, whole plans, and the registered queries."""
