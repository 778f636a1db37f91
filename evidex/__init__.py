"""Spark-native retrieval and review of timestamped visual evidence.

Every operator is a function from DataFrames to DataFrames; nothing here holds
data in Python objects.  See ``README.md`` for the map of modules.
"""
