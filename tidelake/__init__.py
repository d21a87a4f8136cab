"""Spark-native time-series lakehouse operators: every public function maps DataFrames to DataFrames."""
