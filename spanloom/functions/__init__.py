"""Scalar expressions, each written once as SQL text and compiled for Spark and for the oracle engine."""
