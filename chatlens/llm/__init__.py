"""Operators for preparing training data: quality, deduplication, search, mixing, tokens and secrets."""
