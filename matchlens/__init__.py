"""Spark-native analytics over long, frame-by-frame match traces."""
