"""Scenemill: a Spark-native engine for multi-sensor annotation tables."""

__version__ = "0.1.0"
