"""Operators for preparing training text: deduplication, mixing, quality, fingerprints, tokens, privacy, shards."""
