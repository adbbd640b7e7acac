"""Spark-native analytics over media-like tables: files, signatures, vectors, pages, timelines and texts."""
