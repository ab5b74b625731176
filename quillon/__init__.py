"""Quillon: a Spark-native engine for ranked retrieval, telemetry roll-ups and record shaping.

Operators take and return DataFrames and stay lazy; see README.md for the map of modules.
"""

__version__ = "0.1.0"
