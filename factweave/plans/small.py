"""Broadcasting only what is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bounds below which a dimension may be broadcast: its rows, and its bytes as JSON.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 100_000, 16_000_000


def bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when its measured size is within both bounds, else ``df`` unchanged.

    At most ``max_rows + 1`` rows are measured, so the check stays cheap on a large table.
    """
    size = df.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes")).first()
    small = size["n"] <= max_rows and (size["bytes"] or 0) <= max_bytes
    return F.broadcast(df) if small else df


def collected(df: DataFrame, max_rows: int, what: str) -> list:
    """Rows of a small control table; raises if it is larger than its documented bound."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} holds more than the documented bound of {max_rows} rows")
    return rows
