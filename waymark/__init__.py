"""Spark-native transport-accessibility analytics."""
