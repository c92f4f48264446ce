"""Spark-native engine for checking statutory claims in legal summaries."""
