"""Expressions over rows, their lowering to joins and columns, scopes and rules."""
