"""Operators for preparing training data: filtering, deduplication, scoring and encoding of documents."""
