"""carillon: a PySpark-native engine for media-library catalogs and the data derived from them."""
