"""Columns over bars: windows, formats, predicates."""
