"""Relational operators: each takes DataFrames and gives a DataFrame; spans are half-open offsets into a text."""
