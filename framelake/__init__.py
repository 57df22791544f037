"""Spark-native analytics over large media catalogues."""
