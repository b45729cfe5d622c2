"""Scalar mathematics and column expressions."""
