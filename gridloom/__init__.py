"""gridloom: rasters, raster stacks and pixel time series as Spark DataFrames."""
