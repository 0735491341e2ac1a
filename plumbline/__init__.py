"""Spark-native library for deciding which assets to inspect first."""
