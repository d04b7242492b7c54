"""Streams: codes of assets that come in blocks, and duplicates within a time."""
