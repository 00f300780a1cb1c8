"""A Spark-first engine for raster data: images are relations of pixels."""
