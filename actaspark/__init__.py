"""Spark-native analytics over published administrative records."""
