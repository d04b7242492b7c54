"""Scratch storage of these operators: that of the whole library."""

from ..storage import clean, open_input, persisted, scratch, shared_root, write_file

__all__ = ["clean", "open_input", "persisted", "scratch", "shared_root", "write_file"]
