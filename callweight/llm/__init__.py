"""Operators for large training-data corpora; nothing outside this subpackage imports it."""
