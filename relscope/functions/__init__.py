"""Scalar functions by name, for rules and row functions."""

from .registry import FUNCTIONS, call, function

__all__ = ["FUNCTIONS", "call", "function"]
