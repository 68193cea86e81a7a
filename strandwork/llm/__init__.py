"""Corpus-building operators for training data: packing, joins, extraction, fingerprints, scoring, mixing, deduplication."""
