"""Operators for preparing training text: de-duplication, packing, search, tokenising, filtering, extraction."""
