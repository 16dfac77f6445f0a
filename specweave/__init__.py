"""Specification lookup and corpus processing on Spark."""
