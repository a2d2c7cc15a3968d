"""Spark-native market-microstructure analytics."""
