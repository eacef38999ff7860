"""Spark-native text classification analytics and training-data processing."""
