"""Operators for building training text: filters, duplicates, leaks, mixing and token files."""
