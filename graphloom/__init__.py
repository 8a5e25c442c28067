"""Spark-native analytics: property graphs as node and edge DataFrames."""
