"""Operators over tables: codes by group, duplicates, similarity joins, unit-wise comparison."""
