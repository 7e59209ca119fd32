"""Spark-native analytics over machine-stitch data: command streams, pixel tables, candidate tables."""
