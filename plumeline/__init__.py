"""A Spark-native engine for gridded activity, exposure and spatial analytics."""
