"""Retail ledgers and shop reports as PySpark DataFrame jobs."""
