"""Training-data operators: similarity joins, extraction, filtering, tokenizing.

Nothing outside this subpackage imports it.
"""
