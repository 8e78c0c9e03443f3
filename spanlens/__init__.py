"""Spark-native detection of sensitive spans in text, and the jobs around it."""
