"""Spark-native occurrence analytics and counterfactual replay."""

__version__ = "0.1.0"
