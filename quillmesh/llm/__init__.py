"""Operators for preparing training data: deduplication, quality, extraction, packing, safety and sharding."""
