"""Structured Streaming variants of stock posting, daily sales and the low-stock list."""
