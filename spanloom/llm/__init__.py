"""Corpus operators for training data: deduplication, filtering, mixing, packing and sharding.

Nothing else in the library imports this subpackage.
"""
