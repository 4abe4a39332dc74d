"""Point-cloud, raster and outline analytics on Spark DataFrames."""
