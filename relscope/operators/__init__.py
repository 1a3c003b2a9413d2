"""Ordered and keyed operators: on frames (seq), on arrays (arr), and keyed lookups (lookup)."""
