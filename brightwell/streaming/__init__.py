"""The same SELECT surface over unbounded tables.

Projection, WHERE and derived tables need no state, so a query over a registered streaming
DataFrame is itself a streaming DataFrame. TOP over an unbounded table has no end and is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from brightwell.engine import Engine
from brightwell.errors import UnsupportedError


def stream(engine: Engine, text: str, parameters: dict[str, object] | None = None) -> DataFrame:
    """The streaming DataFrame of a batch's last query."""
    frame = engine.sql(text, parameters)
    if not frame.isStreaming:
        raise UnsupportedError("no table of the query is a stream")
    if "GlobalLimit" in frame._jdf.queryExecution().logical().toString():
        raise UnsupportedError("TOP over a stream")
    return frame


