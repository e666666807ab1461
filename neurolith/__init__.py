"""Spark-native analytics for multimodal biosignal recordings."""
