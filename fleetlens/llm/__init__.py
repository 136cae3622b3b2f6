"""Operators for training-data pipelines: tokenizers, near-duplicates, filters, scoring.

Nothing outside this subpackage imports it.
"""
