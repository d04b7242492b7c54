"""Kernels over plain values, and columns made of them."""
