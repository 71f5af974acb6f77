"""Broadcasts behind a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a task whose windows sort them several times.
EACH = 200_000
#: Rows of a narrow table (dates, sources, calendars) that may be sent to every task.
SMALL = 100_000


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """The table marked for broadcast if it has at most ``most`` rows, else as it is, so that a join on keys becomes a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def surely_small(df: DataFrame, what: str, most: int = SMALL) -> DataFrame:
    """The table marked for broadcast; an error where it has more than ``most`` rows, for joins that have no other way."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"{what}: more than {most} rows")
    return F.broadcast(df)


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 512) -> DataFrame:
    """A table of about ``rows`` rows by keys in parts of about EACH rows, so that what a task sorts grows with a key's rows only; a
    table that is small for the tasks at hand stays as it is."""
    parts = -(-rows // EACH)
    return df if parts <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(min(parts, most), *keys)
