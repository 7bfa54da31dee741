"""Spark-native analytics over tables of classified observation pairs."""
