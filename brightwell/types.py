"""The dialect's types: precedence, storage width, range, and the Spark type of each."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import types as T

from brightwell import errors


@dataclass(frozen=True)
class SqlType:
    name: str
    precedence: int  # of two operands the type of the lower number wins
    width: int | None  # bytes of storage, where it is fixed
    spark: T.DataType
    low: int | None = None
    high: int | None = None

    def __str__(self) -> str:
        return self.name

    @property
    def is_integer(self) -> bool:
        return self.low is not None

    @property
    def is_number(self) -> bool:
        return self.is_integer or self is FLOAT

    @property
    def is_string(self) -> bool:
        return isinstance(self.spark, T.StringType)


def _integer(name: str, precedence: int, width: int, spark: T.DataType, low: int, high: int) -> SqlType:
    return SqlType(name, precedence, width, spark, low, high)


DATETIME2 = SqlType("datetime2", 2, 8, T.TimestampNTZType())
FLOAT = SqlType("float", 6, 8, T.DoubleType())
BIGINT = _integer("bigint", 15, 8, T.LongType(), -(1 << 63), (1 << 63) - 1)
INT = _integer("int", 17, 4, T.IntegerType(), -(1 << 31), (1 << 31) - 1)
SMALLINT = _integer("smallint", 18, 2, T.ShortType(), -(1 << 15), (1 << 15) - 1)
TINYINT = _integer("tinyint", 19, 1, T.ShortType(), 0, 255)
BIT = _integer("bit", 20, 1, T.BooleanType(), 0, 1)
NVARCHAR = SqlType("nvarchar", 26, None, T.StringType())
SYSNAME = SqlType("sysname", 26, None, T.StringType())
VARCHAR = SqlType("varchar", 28, None, T.StringType())

#: Types that CREATE TABLE takes.
DECLARABLE = {t.name: t for t in (INT, SMALLINT, TINYINT, BIT)}
#: Types that a parameter may state.
PARAMETER = {t.name: t for t in (INT, SMALLINT, TINYINT, BIT, NVARCHAR, SYSNAME, VARCHAR, BIGINT, FLOAT, DATETIME2)}


def declared(name: str, index: int) -> SqlType:
    found = DECLARABLE.get(name.lower())
    if found is None:
        raise errors.unknown_type(name, index)
    return found


def of_spark(kind: T.DataType) -> SqlType:
    """The dialect's type of a column that was registered from Spark; unknown ones can be projected only."""
    for sql in (INT, BIGINT, SMALLINT, BIT, FLOAT, NVARCHAR, DATETIME2):
        if type(kind) is type(sql.spark):
            return sql
    if isinstance(kind, T.ByteType):
        return SMALLINT
    if isinstance(kind, T.FloatType):
        return FLOAT
    if isinstance(kind, T.TimestampType):
        return DATETIME2
    return SqlType(kind.simpleString(), 1, None, kind)


def of_value(value: object) -> SqlType:
    """The type inferred for a parameter's value."""
    if value is None or isinstance(value, str):
        return NVARCHAR
    if isinstance(value, bool):
        return BIT
    if isinstance(value, int):
        return INT if INT.low <= value <= INT.high else BIGINT
    if isinstance(value, float):
        return FLOAT
    if isinstance(value, datetime.datetime):
        return DATETIME2
    raise errors.UnsupportedError(f"no type is inferred for {type(value).__name__}")


def common(a: SqlType, b: SqlType) -> SqlType:
    return a if a.precedence <= b.precedence else b


def converted(value: object, to: SqlType) -> object:
    """A Python value as one of type `to`, checked for its range."""
    if value is None:
        return None
    if to.is_integer:
        if isinstance(value, str):
            try:
                value = int(value.strip() or 0)
            except ValueError:
                raise errors.conversion_failed(value, to.name) from None
        value = int(value)
        if to is BIT:
            return value != 0
        if not to.low <= value <= to.high:
            raise errors.out_of_range(to.name, value) if to in (TINYINT, SMALLINT) else errors.overflow(to.name)
        return value
    if to is FLOAT:
        try:
            return float(value)
        except ValueError:
            raise errors.conversion_failed(value, to.name) from None
    if to.is_string:
        return ("1" if value else "0") if isinstance(value, bool) else str(value)
    return value
