"""Spark-native analytics over annotation tables, box and mask geometry, feature grids and frame sequences."""

__version__ = "0.1.0"
