"""Orders over a whole table without a single-task window: range partitions, and what lies before each of them.

Rows are written, dealt into ranges of the order and written again; sums per range (one row for each of a few thousand partitions at
most) give every range its start, and windows run inside ranges only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.session import discard, written


def running(df: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds, for each name, the running sum of a column in the given order, the row itself included. The order must be total
    for a result that does not depend on row order; NULLs add nothing."""
    values = [F.coalesce(c, F.lit(0)).alias(f"__{n}") for n, c in sums.items()]
    rows = written(df.select("*", *values))  # the ranges are found by a sample, which would compute the rows a second time
    dealt = written(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    discard(rows)
    totals = dealt.groupBy("__part").agg(*[F.sum(f"__{n}").alias(f"__of_{n}") for n in sums])
    before = Window.partitionBy(F.lit(0)).orderBy("__part")  # one row a range
    starts = totals.select("__part", *[(F.sum(f"__of_{n}").over(before) - F.col(f"__of_{n}")).alias(f"__from_{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(starts), "__part")
    return joined.select(*df.columns, *[(F.col(f"__from_{n}") + F.sum(f"__{n}").over(inside)).alias(n) for n in sums])


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the 1-based place of every row in a total order."""
    return running(df, order, **{name: F.lit(1)})
