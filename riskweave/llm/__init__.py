"""Operators for preparing training text: deduplication, extraction, scoring, packing, search."""
