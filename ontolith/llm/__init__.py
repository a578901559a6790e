"""Operators for preparing training corpora: sharding, deduplication, scans, scoring, packing."""
