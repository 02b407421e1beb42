"""A PySpark-native analytics engine for raster assets and the pipelines that make them."""
