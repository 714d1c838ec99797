"""Spark-native analytics over personal data in text and page layouts."""
