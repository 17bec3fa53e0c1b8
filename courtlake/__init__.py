"""Spark-native league analytics: leakage-free team features from game results."""
