"""Operators on DataFrames of items, tokens, captions and results."""
