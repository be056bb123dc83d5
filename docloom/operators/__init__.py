"""Joins, groupings and ordered-sequence jobs over object tables."""
