"""Scalar expressions on 64-bit lanes."""
