"""Spark-native document analytics, retrieval, scoring and evaluation."""
