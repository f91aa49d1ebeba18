"""Operators for large training corpora: mixing, media, tokens, deduplication, classifiers, personal data."""
