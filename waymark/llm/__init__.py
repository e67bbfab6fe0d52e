"""Operators for preparing training data on Spark."""
