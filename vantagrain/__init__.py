"""Spark-native disclosure-risk and data-utility analytics."""
