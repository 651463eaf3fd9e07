"""Numbered errors in the manner of the dialect, and the few that carry no number."""

from __future__ import annotations

#: Fixed values that go with every numbered error.
HRESULT = 0x80131904 - (1 << 32)
SOURCE = "Core Microsoft SqlClient Data Provider"
PRODUCT, PRODUCT_VERSION, EVENT_SOURCE = "Microsoft SQL Server", "99.00.1000", "MSSQLServer"
HELP_URL, HELP_LINK = "https://go.microsoft.com/fwlink", "20476"


class SqlError(Exception):
    def __init__(self, number: int, severity: int, state: int, message: str):
        super().__init__(message)
        self.number, self.severity, self.state, self.message = number, severity, state, message
        self.hresult, self.source, self.is_transient = HRESULT, SOURCE, False
        self.data = {
            "HelpLink.ProdName": PRODUCT,
            "HelpLink.ProdVer": PRODUCT_VERSION,
            "HelpLink.EvtSrc": EVENT_SOURCE,
            "HelpLink.EvtID": str(number),
            "HelpLink.BaseHelpUrl": HELP_URL,
            "HelpLink.LinkId": HELP_LINK,
        }

    @property
    def errors(self) -> list[SqlError]:
        return [self]


class UnsupportedError(NotImplementedError):
    """Valid in the dialect, but outside of what this engine takes."""


class InvalidOperationError(RuntimeError):
    """The API was used in the wrong state."""


def syntax_near(text: str) -> SqlError:
    return SqlError(102, 15, 1, f"Incorrect syntax near '{text}'.")


def syntax_near_keyword(text: str) -> SqlError:
    return SqlError(156, 15, 1, f"Incorrect syntax near the keyword '{text}'.")


def identifier_too_long(start: str) -> SqlError:
    return SqlError(103, 15, 4, f"The identifier that starts with '{start}' is too long. Maximum length is 128.")


def nested_too_deeply() -> SqlError:
    return SqlError(191, 15, 1, "Some part of your SQL statement is nested too deeply. Rewrite the query or break it up into smaller queries.")


def unclosed_quote(text: str) -> SqlError:
    return SqlError(105, 15, 1, f"Unclosed quotation mark after the character string '{text}'.")


def missing_end_comment() -> SqlError:
    return SqlError(113, 15, 1, "Missing end comment mark '*/'.")


def must_declare(name: str) -> SqlError:
    return SqlError(137, 15, 2, f'Must declare the scalar variable "@{name}".')


def unknown_function(name: str) -> SqlError:
    return SqlError(195, 15, 10, f"'{name}' is not a recognized built-in function name.")


def invalid_column(name: str) -> SqlError:
    return SqlError(207, 16, 1, f"Invalid column name '{name}'.")


def invalid_object(name: str) -> SqlError:
    return SqlError(208, 16, 1, f"Invalid object name {name}.")


def values_arity() -> SqlError:
    return SqlError(213, 16, 1, "Column name or number of supplied values does not match table definition.")


def uneven_rows() -> SqlError:
    return SqlError(10709, 16, 1, "The number of columns for each row in a table value constructor must be the same.")


def out_of_range(type_name: str, value: object) -> SqlError:
    return SqlError(220, 16, 1, f"Arithmetic overflow error for data type {type_name}, value = {value}.")


def conversion_failed(value: object, type_name: str) -> SqlError:
    return SqlError(245, 16, 1, f"Conversion failed when converting the value '{value}' to data type {type_name}.")


def incompatible(a: object, b: object, operator: str) -> SqlError:
    return SqlError(402, 16, 1, f"The data types {a} and {b} are incompatible in the '{operator}' operator.")


def null_not_allowed(column: str, table: str) -> SqlError:
    return SqlError(515, 16, 2, f"Cannot insert the value NULL into column '{column}', table '{table}'; column does not allow nulls. INSERT fails.")


def wrong_arguments(name: str, n: int) -> SqlError:
    return SqlError(174, 15, 1, f"The {name} function requires {n} argument(s).")


def top_negative() -> SqlError:
    return SqlError(127, 15, 1, "A TOP N or FETCH rowcount value may not be negative.")


def top_not_integer() -> SqlError:
    return SqlError(1060, 15, 1, "The number of rows provided for a TOP or FETCH clauses row count parameter must be an integer.")


def column_twice(column: str, table: str) -> SqlError:
    return SqlError(2705, 16, 3, f"Column names in each table must be unique. Column name '{column}' in table '{table}' is specified more than once.")


def already_there(name: str) -> SqlError:
    return SqlError(2714, 16, 6, f"There is already an object named '{name}' in the database.")


def unknown_type(name: str, index: int) -> SqlError:
    return SqlError(2715, 16, 6, f"Column, parameter, or variable #{index}: Cannot find data type {name}.")


def unbound_identifier(name: str) -> SqlError:
    return SqlError(4104, 16, 1, f'The multi-part identifier "{name}" could not be bound.')


def column_in_top(name: str) -> SqlError:
    return SqlError(4115, 15, 1, f'The reference to column "{name}" is not allowed in an argument to a TOP, OFFSET, or FETCH clause. Only references to columns at an outer scope or standalone expressions and subqueries are allowed here.')


def overflow(type_name: str = "int") -> SqlError:
    return SqlError(8115, 16, 2, f"Arithmetic overflow error converting expression to data type {type_name}.")


def divide_by_zero() -> SqlError:
    return SqlError(8134, 16, 1, "Divide by zero error encountered.")


def unnamed_column(index: int, table: str) -> SqlError:
    return SqlError(8155, 16, 2, f"No column name was specified for column {index} of '{table}'.")


def from_spark(error: Exception) -> Exception:
    """The numbered error for a condition that Spark met first while running, else the error itself."""
    condition = getattr(error, "getCondition", lambda: None)() or ""
    text = str(error)
    if condition in ("DIVIDE_BY_ZERO", "REMAINDER_BY_ZERO") or "DIVIDE_BY_ZERO]" in text or "REMAINDER_BY_ZERO]" in text:
        return divide_by_zero()
    if "] tinyint overflow" in text:
        return overflow("tinyint")
    if condition in ("ARITHMETIC_OVERFLOW", "CAST_OVERFLOW", "BINARY_ARITHMETIC_OVERFLOW") or "_OVERFLOW]" in text:
        return overflow()
    if condition == "CAST_INVALID_INPUT" or "CAST_INVALID_INPUT]" in text:
        return SqlError(245, 16, 1, "Conversion failed when converting a character string to a numeric data type.")
    return error
