"""Loaders that lay a property graph over stored tables."""
