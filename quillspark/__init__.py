"""Spark-native preparation, screening and evaluation of labelled text."""
