"""Spark-native analytics over event graphs, market series and news text."""
