"""Spark-native curation and analytics of web corpora."""
