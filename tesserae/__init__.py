"""Spark-native content analytics: duplicates, near duplicates, search and neighbours over content-addressed tables."""
