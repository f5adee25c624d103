"""Estimating and pricing analytics as Spark transformations."""
