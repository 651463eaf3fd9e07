"""Scalar functions: a registry from lower-case names to what they take, give and lower to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from brightwell import errors
from brightwell.types import BIT, INT, SqlType


@dataclass(frozen=True)
class Function:
    name: str
    arguments: int
    result: Callable[[list[SqlType]], SqlType]
    lower: Callable[[list[Column], list[SqlType]], Column]
    fold: Callable[[list, list[SqlType]], object]


def _abs_type(kinds: list[SqlType]) -> SqlType:
    if not kinds[0].is_number or kinds[0] is BIT:
        raise errors.UnsupportedError(f"ABS of {kinds[0]}")
    return kinds[0]


def _length_type(kinds: list[SqlType]) -> SqlType:
    if kinds[0].width is None and not kinds[0].is_string:
        raise errors.UnsupportedError(f"DATALENGTH of {kinds[0]}")
    return INT


def _length(columns: list[Column], kinds: list[SqlType]) -> Column:
    """Bytes of storage: fixed by the type, or those of a Unicode string's two-byte units."""
    (column,), (kind,) = columns, kinds
    if kind.is_string:
        return F.octet_length(F.encode(column, "UTF-16LE" if kind.precedence == 26 else "UTF-8")).cast("int")
    return F.when(column.isNotNull(), F.lit(kind.width)).cast("int")


def _fold_abs(values: list, kinds: list[SqlType]) -> object:
    value = None if values[0] is None else abs(values[0])
    if value is not None and kinds[0].is_integer and value > kinds[0].high:
        raise errors.overflow(kinds[0].name)
    return value


def _fold_length(values: list, kinds: list[SqlType]) -> object:
    if values[0] is None:
        return None
    if kinds[0].is_string:
        return len(values[0].encode("utf-16-le" if kinds[0].precedence == 26 else "utf-8"))
    return kinds[0].width


REGISTRY = {
    f.name: f
    for f in (
        Function("abs", 1, _abs_type, lambda columns, kinds: F.abs(columns[0]).cast(kinds[0].spark), _fold_abs),
        Function("datalength", 1, _length_type, _length, _fold_length),
    )
}


def resolve(name: str, n_arguments: int) -> Function:
    found = REGISTRY.get(name.lower())
    if found is None:
        raise errors.unknown_function(name)
    if found.arguments != n_arguments:
        raise errors.wrong_arguments(found.name, found.arguments)
    return found
