"""Spark-native analytics over event timelines."""
