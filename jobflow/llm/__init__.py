"""Operators for training-data corpora; see the README section on them."""
