"""Readers and writers for review tables and word sets."""
