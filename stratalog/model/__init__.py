"""Vocabularies, table schemas and the rule catalogue."""
