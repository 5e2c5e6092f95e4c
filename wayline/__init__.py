"""Wayline: a PySpark-native engine for event streams, trajectories and text corpora."""
