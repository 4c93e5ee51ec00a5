"""Spark-native analytics over job postings: normalisation, property graph, search,
recommendation, entity resolution and training-data preparation."""

__version__ = "0.1.0"
