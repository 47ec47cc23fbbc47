"""Operators over bar tables."""

from barlab.operators import pivots, slices  # noqa: F401  (register their rules)
