"""Spark-native analytics over agent memories, conversations and text corpora."""
