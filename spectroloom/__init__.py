"""Spectral analytics on Spark."""
