"""Syntax trees. Frozen, so that a parsed batch may be kept and bound again."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: int | str | None


@dataclass(frozen=True)
class Parameter:
    name: str


@dataclass(frozen=True)
class Global:
    name: str


@dataclass(frozen=True)
class Reference:
    parts: tuple[str, ...]


@dataclass(frozen=True)
class Unary:
    operator: str
    operand: Expression


@dataclass(frozen=True)
class Binary:
    operator: str
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Call:
    name: str
    arguments: tuple[Expression, ...]


Expression = Literal | Parameter | Global | Reference | Unary | Binary | Call


@dataclass(frozen=True)
class Compare:
    operator: str  # = <> > >= < <=
    left: Expression
    right: Expression


@dataclass(frozen=True)
class IsNull:
    operand: Expression
    negated: bool


@dataclass(frozen=True)
class Not:
    operand: Predicate


@dataclass(frozen=True)
class Junction:
    operator: str  # and, or
    parts: tuple[Predicate, ...]


Predicate = Compare | IsNull | Not | Junction


@dataclass(frozen=True)
class Star:
    qualifier: str | None = None


@dataclass(frozen=True)
class Item:
    expression: Expression
    alias: str | None = None


@dataclass(frozen=True)
class TableSource:
    name: str
    alias: str | None = None
    written: str = ""


@dataclass(frozen=True)
class DerivedSource:
    select: Select
    alias: str


@dataclass(frozen=True)
class Select:
    items: tuple[Item | Star, ...]
    source: TableSource | DerivedSource | None = None
    where: Predicate | None = None
    top: Expression | None = None


@dataclass(frozen=True)
class ColumnDefinition:
    name: str
    type_name: str
    nullable: bool = True


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDefinition, ...]


@dataclass(frozen=True)
class Insert:
    table: str
    written: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Expression, ...], ...] = field(default=())


@dataclass(frozen=True)
class SetOption:
    name: str
    on: bool


Statement = Select | CreateTable | Insert | SetOption
