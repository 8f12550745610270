"""Spark-native analytics over program-behaviour facts."""
