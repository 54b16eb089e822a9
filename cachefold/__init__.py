"""Spark-native analytics over the state of key-value caches for language-model serving."""
