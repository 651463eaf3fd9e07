"""Case-insensitive tables of one engine: created ones, registered DataFrames, and system tables.

A created table's rows are the values that INSERT statements brought, so they are bounded by
statement text; they become one DataFrame when the table is read, however many inserts there were.
A reader keeps the DataFrame it was opened with, since rows are only ever appended.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from brightwell import errors
from brightwell.sources import systypes
from brightwell.types import SqlType, of_spark


@dataclass(frozen=True)
class TableColumn:
    name: str
    kind: SqlType
    nullable: bool = True


@dataclass
class Table:
    name: str
    columns: list[TableColumn]
    rows: list[tuple] | None = None  # of a created table
    frame: DataFrame | None = None  # of a registered one, or what was made of the rows
    made_of: int = field(default=-1)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.kind.spark, True) for c in self.columns])

    def read(self, spark: SparkSession) -> DataFrame:
        if self.rows is not None and self.made_of != len(self.rows):
            self.frame, self.made_of = spark.createDataFrame(list(self.rows), self.schema).coalesce(1), len(self.rows)
        return self.frame


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.user: dict[str, Table] = {}
        self.system: dict[str, Table] = {}

    def register(self, name: str, frame: DataFrame) -> None:
        """Make a DataFrame readable under a name; a table of that name is replaced."""
        self.user[name.lower()] = Table(name, [TableColumn(f.name, of_spark(f.dataType), f.nullable) for f in frame.schema], None, frame)

    def register_parquet(self, folder: str, *names: str) -> None:
        for name in names:
            self.register(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))

    def create(self, name: str, columns: list[TableColumn]) -> None:
        if name.lower() in self.user:
            raise errors.already_there(name)
        seen: set[str] = set()
        for c in columns:
            if c.name.lower() in seen:
                raise errors.column_twice(c.name, name)
            seen.add(c.name.lower())
        self.user[name.lower()] = Table(name, columns, [])

    def find(self, name: str, written: str) -> Table:
        """User tables first, then system tables."""
        found = self.user.get(name.lower()) or self._system(name.lower())
        if found is None:
            raise errors.invalid_object(written)
        return found

    def writable(self, name: str, written: str) -> Table:
        found = self.user.get(name.lower())
        if found is None:
            raise errors.invalid_object(written)
        if found.rows is None:
            raise errors.UnsupportedError(f"table {found.name} was registered from Spark and is read-only")
        return found

    def _system(self, name: str) -> Table | None:
        if name == "systypes" and name not in self.system:
            self.system[name] = Table("systypes", [TableColumn(*c) for c in systypes.COLUMNS], systypes.rows())
        return self.system.get(name)

    def snapshot(self) -> dict[str, tuple[Table, int | None]]:
        return {k: (t, None if t.rows is None else len(t.rows)) for k, t in self.user.items()}

    def restore(self, held: dict[str, tuple[Table, int | None]]) -> None:
        """Back to a snapshot: tables made since are gone, and so are rows inserted since."""
        self.user = {}
        for k, (t, n) in held.items():
            self.user[k] = t if n is None else Table(t.name, t.columns, t.rows[:n])
