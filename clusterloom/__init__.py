"""Spark-native topic clustering, site analysis and corpus processing."""
