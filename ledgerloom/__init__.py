"""Spark-native engine for grounded financial question answering and corpus preparation."""
