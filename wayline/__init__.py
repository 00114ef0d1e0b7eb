"""Spark-native analytics over multi-camera object tracks."""
