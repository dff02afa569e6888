"""Spark-native engine for signal records and the tables around them."""
