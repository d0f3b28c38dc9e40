"""Operators for text corpora: tokens, leakage, shared spans, look-alike text and variant names."""
