"""loomgrid: raster, instance and corpus analytics expressed on PySpark DataFrames."""
