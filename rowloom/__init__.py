"""rowloom: line-network, raster and corpus analytics on Spark DataFrames."""
