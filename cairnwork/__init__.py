"""Spark-native corpus, conversation and evaluation analytics."""
