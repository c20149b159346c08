"""Operators: DataFrame in, DataFrame out."""

KEYS = ("image_id", "sel_id")
