"""Spark-native media-risk analytics."""
