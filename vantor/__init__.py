"""vantor: a PySpark-native engine for embedding, raster and corpus analytics."""
