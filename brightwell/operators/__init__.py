"""Operators as Column expressions: arithmetic, bitwise, comparison."""
