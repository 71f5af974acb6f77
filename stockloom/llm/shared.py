"""What several operators of this subpackage need: written intermediate tables and size-checked joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.session import discard, written

__all__ = ["BROADCAST_ROWS", "discard", "join_ids", "read", "texts", "written"]

#: Rows of a narrow id table that may be broadcast (16 bytes or so each); larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def join_ids(big: DataFrame, ids: DataFrame, on: str | list[str], how: str, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Join against a written table of ids, broadcast only where its counted rows keep within ``bound``."""
    if ids.limit(bound + 1).count() <= bound:
        return big.join(F.broadcast(ids), on, how)
    return big.join(ids.hint("merge"), on, how)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
