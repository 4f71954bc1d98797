"""Spark-native inference and optimisation over graph-structured models."""
