"""Microstructure and property analytics on Spark."""
