"""Spark-native text reduction, request routing and corpus analytics."""
