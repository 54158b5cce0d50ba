"""Subspace analytics on Spark."""
