"""Where tables come from: pairs of an original and a released table."""

from .pair import ReleasePair, read_table

__all__ = ["ReleasePair", "read_table"]
