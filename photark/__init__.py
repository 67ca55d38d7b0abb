"""photark: catalog, image and training-data analytics on Spark."""
