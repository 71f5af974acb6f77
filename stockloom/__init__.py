"""Spark-native analytics for equity research: point-in-time data, scores, ranks and their validation."""
