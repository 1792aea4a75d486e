"""Spark-native analytics for narrative prose: cleaning, segmentation, records, comparison."""
