"""Candela: a Spark-native engine for bar-series analytics and text-corpus processing."""
