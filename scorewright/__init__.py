"""Spark-native scoring of response logs, trajectories and point tables."""
