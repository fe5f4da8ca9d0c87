"""Spark-native evidence triage and corpus preparation over DataFrames."""
