"""Spark-native cleaning, profiling and typing of messy single-table sources."""
