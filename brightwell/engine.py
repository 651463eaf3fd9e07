"""The engine and its connection, command, parameter, transaction and reader objects."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from brightwell import errors
from brightwell.operators.comparison import ANSI, MODES
from brightwell.plans import ast
from brightwell.plans.binder import Binder, Bound
from brightwell.plans.parser import parse
from brightwell.sources.catalog import Catalog
from brightwell.types import PARAMETER, SqlType, converted, of_value

VERSION = "Brightwell T-SQL on Apache Spark"


class _DBNull:
    """SQL NULL as a value, apart from the absence of a result."""

    def __repr__(self) -> str:
        return "DBNULL"

    def __bool__(self) -> bool:
        return False


DBNULL = _DBNull()


@dataclass(frozen=True)
class Outcome:
    """What a statement gave: a query's rows, or a number of rows affected."""

    bound: Bound | None = None
    affected: int = -1


class Engine:
    """One isolated database on a Spark session.

    null_comparison is "ansi" (a comparison with NULL is unknown) or "two_valued" (NULL equals
    nothing, differs from everything and is lower than any value).
    """

    def __init__(self, spark: SparkSession, null_comparison: str = ANSI, version: str = VERSION):
        if null_comparison not in MODES:
            raise ValueError(f"null_comparison is one of {MODES}")
        self.spark, self.null_comparison, self.version = spark, null_comparison, version
        self.catalog = Catalog(spark)
        self.options: dict[str, bool] = {}

    def register(self, name: str, frame: DataFrame) -> None:
        self.catalog.register(name, frame)

    def register_parquet(self, folder: str, *names: str) -> None:
        self.catalog.register_parquet(folder, *names)

    def connect(self) -> Connection:
        return Connection(self)

    def sql(self, text: str, parameters: dict[str, object] | None = None) -> DataFrame:
        """The DataFrame of the batch's last query; statements before it take effect."""
        bound = [o.bound for o in self.run(text, bind(parameters or {})) if o.bound is not None]
        if not bound:
            raise errors.InvalidOperationError("the batch has no query")
        return bound[-1].frame

    def run(self, text: str, parameters: dict[str, tuple[object, SqlType]]) -> list[Outcome]:
        """Run a batch: changes at once and in order, queries as lazy DataFrames over what they saw."""
        binder = Binder(self.catalog, parameters, self.version, self.null_comparison)
        out: list[Outcome] = []
        for statement in parse(text):
            if isinstance(statement, ast.Select):
                out.append(Outcome(bound=_translated(lambda s=statement: binder.select(s))))
            elif isinstance(statement, ast.CreateTable):
                binder.create(statement)
            elif isinstance(statement, ast.Insert):
                out.append(Outcome(affected=binder.insert(statement)))
            else:
                self.options[statement.name] = statement.on
        return out


@dataclass
class Parameter:
    """A named value; the type is inferred for None, str, int, bool, float and datetime, or stated by name."""

    name: str
    value: object = None
    db_type: str | None = None

    @property
    def kind(self) -> SqlType:
        if self.db_type is None:
            return of_value(self.value)
        if self.db_type.lower() not in PARAMETER:
            raise errors.UnsupportedError(f"parameter type {self.db_type}")
        return PARAMETER[self.db_type.lower()]


def bind(parameters: dict[str, object] | list[Parameter]) -> dict[str, tuple[object, SqlType]]:
    """Values and types by lower-case name without the leading @."""
    held = [Parameter(k, v) for k, v in parameters.items()] if isinstance(parameters, dict) else parameters
    return {p.name.lstrip("@").lower(): (converted(p.value, p.kind), p.kind) for p in held}


class Parameters:
    """A command's parameters, in the order in which they were added."""

    def __init__(self):
        self._held: list[Parameter] = []

    def add(self, parameter: Parameter | str, value: object = None, db_type: str | None = None) -> Parameter:
        new = parameter if isinstance(parameter, Parameter) else Parameter(parameter, value, db_type)
        self._held.append(new)
        return new

    def clear(self) -> None:
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)

    def __iter__(self) -> Iterator[Parameter]:
        return iter(self._held)


class Transaction:
    """Commit keeps everything; rollback restores the tables as they were at the beginning."""

    def __init__(self, connection: Connection):
        self.connection = connection
        self._held = connection.engine.catalog.snapshot()
        self._open = True

    def _close(self) -> None:
        if not self._open:
            raise errors.InvalidOperationError("the transaction has ended")
        self._open = False

    def commit(self) -> None:
        self._close()

    def rollback(self) -> None:
        self._close()
        self.connection.engine.catalog.restore(self._held)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self._open:
            self.commit() if kind is None else self.rollback()


class Connection:
    def __init__(self, engine: Engine):
        self.engine, self.state, self.connection_string = engine, "closed", ""

    def open(self) -> Connection:
        self.state = "open"
        return self

    def close(self) -> None:
        self.state = "closed"

    def begin_transaction(self) -> Transaction:
        return Transaction(self)

    def create_command(self, text: str = "") -> Command:
        return Command(self, text)

    def __enter__(self) -> Connection:
        return self.open()

    def __exit__(self, *_) -> None:
        self.close()


@dataclass
class Command:
    connection: Connection
    text: str = ""
    parameters: Parameters = field(default_factory=Parameters)

    def __post_init__(self):
        self.text = self.text or ""
        self._timeout, self._transaction, self.design_time_visible = 30, None, True

    @property
    def command_type(self) -> str:
        return "text"

    @command_type.setter
    def command_type(self, value: str) -> None:
        if value != "text":
            raise errors.UnsupportedError(f"command type {value}")

    @property
    def timeout(self) -> int:
        """Stored only: queries run as long as Spark takes."""
        return self._timeout

    @timeout.setter
    def timeout(self, value: int) -> None:
        if value < 0:
            raise ValueError("timeout may not be negative")
        self._timeout = value

    @property
    def transaction(self) -> Transaction | None:
        return self._transaction

    @transaction.setter
    def transaction(self, value: Transaction | None) -> None:
        if value is not None and (not isinstance(value, Transaction) or value.connection is not self.connection):
            raise errors.InvalidOperationError("the transaction belongs to another connection")
        self._transaction = value

    def cancel(self) -> None:
        raise errors.UnsupportedError("cancel")

    def prepare(self) -> None:
        raise errors.UnsupportedError("prepare")

    def _run(self, what: str) -> list[Outcome]:
        if not self.text:
            raise errors.InvalidOperationError(f"{what}: CommandText property has not been initialized")
        return self.connection.engine.run(self.text, bind(list(self.parameters)))

    def execute_reader(self) -> Reader:
        return Reader(self._run("ExecuteReader"))

    def execute_scalar(self) -> object:
        """First cell of the first result: None without any row, DBNULL for a NULL."""
        with Reader(self._run("ExecuteScalar")) as reader:
            return reader[0] if reader.read() else None

    def execute_non_query(self) -> int:
        """Rows affected in all, or -1 if no statement counts them. Queries are run too."""
        outcomes = self._run("ExecuteNonQuery")
        for o in outcomes:
            if o.bound is not None:
                _translated(lambda f=o.bound.frame: f.write.format("noop").mode("overwrite").save())
        counts = [o.affected for o in outcomes if o.affected >= 0]
        return sum(counts) if counts else -1


def _translated(action):
    try:
        return action()
    except (PySparkException, Py4JJavaError) as error:
        found = errors.from_spark(error)
        if found is error:
            raise
        raise found from error


class Reader:
    """Forward-only rows of a batch's queries, fetched partition by partition."""

    def __init__(self, outcomes: list[Outcome]):
        self._bound = [o.bound for o in outcomes if o.bound is not None]
        counts = [o.affected for o in outcomes if o.affected >= 0]
        self.records_affected = sum(counts) if counts else -1
        self._at, self._rows, self._row, self.is_closed = 0, None, None, False

    @property
    def _now(self) -> Bound | None:
        return self._bound[self._at] if self._at < len(self._bound) else None

    @property
    def field_count(self) -> int:
        return len(self._now.names) if self._now else 0

    def read(self) -> bool:
        if self.is_closed:
            raise errors.InvalidOperationError("the reader is closed")
        if self._now is None:
            return False
        if self._rows is None:
            self._rows = _translated(self._now.frame.toLocalIterator)
        self._row = _translated(lambda: next(self._rows, None))
        return self._row is not None

    def next_result(self) -> bool:
        self._at, self._rows, self._row = self._at + 1, None, None
        return self._now is not None

    def _place(self, key: int | str) -> int:
        if isinstance(key, int):
            if not 0 <= key < self.field_count:
                raise IndexError(key)
            return key
        for i, n in enumerate(self._now.names if self._now else []):
            if n.lower() == key.lower():
                return i
        raise IndexError(key)

    def __getitem__(self, key: int | str) -> object:
        if self._row is None:
            raise errors.InvalidOperationError("there is no current row")
        value = self._row[self._place(key)]
        return DBNULL if value is None else value

    def get_name(self, i: int) -> str:
        return self._now.names[self._place(i)]

    def get_ordinal(self, name: str) -> int:
        return self._place(name)

    def is_null(self, i: int) -> bool:
        return self[i] is DBNULL

    def get_int32(self, i: int) -> int:
        value = self[i]
        if not isinstance(value, int) or isinstance(value, bool):
            raise TypeError(f"column {i} holds {value!r}, not an int")
        return value

    def get_string(self, i: int) -> str:
        value = self[i]
        if not isinstance(value, str):
            raise TypeError(f"column {i} holds {value!r}, not a string")
        return value

    def __iter__(self) -> Iterator[Row]:
        while self.read():
            yield self._row

    def close(self) -> None:
        self.is_closed, self._rows, self._row = True, None, None

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.close()
