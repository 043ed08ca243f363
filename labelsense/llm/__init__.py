"""Operators for preparing training text: deduplication, mixing, packing, archives, rules and models."""
