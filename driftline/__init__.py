"""Spark-native clustering analytics for streams of embedding vectors."""
