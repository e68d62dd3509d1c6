"""Readers and writers for landed files and tables."""
