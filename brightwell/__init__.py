"""T-SQL analytics lowered onto Spark DataFrames."""

from brightwell.engine import DBNULL, Command, Connection, Engine, Parameter, Reader, Transaction
from brightwell.errors import InvalidOperationError, SqlError, UnsupportedError

__all__ = ["DBNULL", "Command", "Connection", "Engine", "InvalidOperationError", "Parameter", "Reader", "SqlError", "Transaction", "UnsupportedError"]
