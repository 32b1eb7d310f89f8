"""Spark-native market analytics: DataFrame-to-DataFrame operators over bars, events and reference tables."""
