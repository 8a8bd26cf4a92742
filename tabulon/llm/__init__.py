"""Operators for preparing training text: encoding, filtering, deduplication, search and placement."""
