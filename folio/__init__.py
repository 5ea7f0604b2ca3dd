"""Spark-native document registry engine."""
