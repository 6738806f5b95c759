"""Spark-native context selection and text retrieval engine."""
