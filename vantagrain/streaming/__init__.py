"""Measures that can be kept up to date over a stream of released records."""

from .classes import class_sizes, k_level_sink

__all__ = ["class_sizes", "k_level_sink"]
