"""Operators for preparing training text: tokens, duplicates, privacy, quality, packing, page text."""
