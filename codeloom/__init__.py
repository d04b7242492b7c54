"""Similarity-preserving content fingerprints as Spark columns, aggregates, joins and streams."""
