"""Comparisons, three-valued by default; two-valued ones treat NULL as equal to nothing and lowest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSI, TWO_VALUED = "ansi", "two_valued"
MODES = (ANSI, TWO_VALUED)


def ansi(operator: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[operator]


def two_valued(operator: str, a: Column, b: Column) -> Column:
    true_if = lambda c: F.coalesce(c, F.lit(False))
    if operator == "=":
        return true_if(a == b)
    if operator == "<>":
        return ~true_if(a == b)
    if operator == ">":
        return a.isNotNull() & (b.isNull() | true_if(a > b))
    if operator == ">=":
        return b.isNull() | true_if(a >= b)
    if operator == "<":
        return b.isNotNull() & (a.isNull() | true_if(a < b))
    return a.isNull() | true_if(a <= b)


def lower(mode: str, operator: str, a: Column, b: Column) -> Column:
    return (two_valued if mode == TWO_VALUED else ansi)(operator, a, b)
