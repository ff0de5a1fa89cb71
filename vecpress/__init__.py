"""Spark-native vector compression, nearest-neighbour search and evaluation."""
