"""Spanloom: document analytics on Spark DataFrames, with every result a span into the original text."""
