"""A PySpark-native retrieval and corpus-processing engine."""
