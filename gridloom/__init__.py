"""Spark-native analytics over drawing entities, floors, graphs and routes."""

__version__ = "0.1.0"
