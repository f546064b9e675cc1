"""Spark-native curation and evaluation of object-detection datasets."""
