"""Operators for preparing training text: dedup, search, language, quality, toxicity, tokens, packing."""
