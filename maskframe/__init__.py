"""maskframe: a PySpark-native engine for image-instance masks and corpus preparation."""
