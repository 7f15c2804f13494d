"""Broadcast only what has been counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 100_000


def small(df: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """``df`` as a broadcast table when it has at most ``limit`` rows, else as it is.

    The rows are fetched once, one more than the limit at most, so a small table is
    not computed again. A larger one stays distributed and the join becomes a
    shuffle join, whose hot keys adaptive execution splits.
    """
    rows = df.limit(limit + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= limit else df
