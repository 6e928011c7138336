"""tapeworks: a PySpark-native engine for dense market time series."""
