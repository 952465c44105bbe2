"""Spark-native analytics over work-session logs."""
