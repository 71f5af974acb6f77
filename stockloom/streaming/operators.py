"""Structured Streaming forms of the event operators. Each takes a streaming (or batch) frame and returns one, so the
same function gives the batch twin; state is bounded by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.sources import store

NEWS = "ticker long, event_id long, ts timestamp, event_type string, value double"


def deduplicated(events: DataFrame, key: list[str], late: str = "7 days") -> DataFrame:
    """One row per key inside the watermark (a batch frame: the first one of each key by ts, then event_id)."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    others = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct("ts", "event_id")).alias("x")).select(*key, *[f"x.{c}" for c in others])


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Articles per name and day; sliding 7- and 30-day sums are built from it, instead of copying each row into 30 windows."""
    day = F.window("ts", "1 day")
    return events.withWatermark("ts", late).groupBy("ticker", day.alias("w")).agg(F.count("*").alias("c"), F.sum("value").alias("value")).select("ticker", F.to_date("w.start").alias("day"), "c", "value")


def one_a_day(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first event of each name and day."""
    w = F.window("ts", "1 day").alias("w")
    first = F.min(F.struct("ts", "event_id", "event_type")).alias("first")
    return events.withWatermark("ts", late).groupBy("ticker", w).agg(first).select("ticker", F.to_date("w.start").alias("day"), "first.event_id", "first.event_type")


def stories(events: DataFrame, gap: str = "4 days", late: str = "1 day") -> DataFrame:
    """A story goes on while gaps stay inside ``gap``: start, last event's end, number of events."""
    w = F.session_window("ts", gap).alias("w")
    return events.withWatermark("ts", late).groupBy("ticker", w).agg(F.count("*").alias("n")).select("ticker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def enriched(events: DataFrame, directory: DataFrame) -> DataFrame:
    """Stream-static join on a directory of validity intervals (ticker, from_day, to_day, name)."""
    d = F.to_date("ts")
    return events.join(directory, "ticker", "left").where(F.col("from_day").isNull() | ((d >= F.col("from_day")) & (F.col("to_day").isNull() | (d < F.col("to_day")))))


def mention_delta(daily: DataFrame) -> DataFrame:
    """Each day's count against the day before: a join of a table of days with itself, shifted."""
    before = daily.select("ticker", F.date_add("day", 1).alias("day"), F.col("c").alias("prior"))
    return daily.join(before, ["ticker", "day"], "left").withColumn("delta", F.col("c") - F.col("prior"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain a stream into Parquet with availableNow and read the result."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def each_batch(stream: DataFrame, checkpoint: str, write, mode: str = "update") -> None:
    """Drain what has arrived, ``write`` (batch, its number) taking each micro-batch."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def upsert_days(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Changed rows of a stream (with a ``day``) into a store of versions: a replayed batch replaces itself, and other rows of a day
    stay. ``newest_days`` reads it."""
    each_batch(stream, checkpoint, lambda batch, number: store.put(batch, path, number, ["day"]))


def newest_days(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return store.newest(store.records(spark, path), keys)


def captured(stream: DataFrame, root: str, checkpoint: str, today: str, order: list[str]) -> None:
    """An idempotent daily capture of a stream (ticker, day, ...); see ``store.capture``."""
    each_batch(stream, checkpoint, lambda batch, number: store.capture(batch, root, today, order, number), "append")


def extended_facts(stream: DataFrame, root: str, checkpoint: str) -> None:
    """A stream of filed facts into the table of intervals in which they were known; see ``store.extend_facts``."""
    each_batch(stream, checkpoint, lambda batch, number: store.extend_facts(batch, root, number), "append")


def daily_owner_flow(trades: DataFrame, path: str, checkpoint: str) -> None:
    """A stream of trades (ticker, owner, d, code, value) to daily sums by owner: each micro-batch is summed and written under its own
    number, so a replayed batch overwrites itself and late trades of an old day are simply added to it when the table is read."""

    def write(batch: DataFrame, number: int) -> None:
        buy, sell = F.col("code") == "P", F.col("code") == "S"
        net = F.sum(F.when(buy, F.col("value")).when(sell, -F.col("value")).otherwise(0.0)).alias("net")
        sums = batch.groupBy("ticker", "owner", "d").agg(net, F.bool_or(buy).alias("bought"))
        sums.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    trades.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start().awaitTermination()


def half_year_flow(daily: DataFrame, days: int = 183) -> DataFrame:
    """ticker, d, flow (sum of the last days), buyers (distinct owners who bought in them) of every day with a trade. A buyer's purchases
    are turned into stretches of days that they cover, so distinct buyers are a running count of starts and ends."""
    one = daily.groupBy("ticker", "d", "owner").agg(F.sum("net").alias("net"), F.bool_or("bought").alias("bought"))
    by_day = one.groupBy("ticker", "d").agg(F.sum("net").alias("v"))
    w = Window.partitionBy("ticker").orderBy(F.unix_date("d")).rangeBetween(-days, 0)
    flow = by_day.select("ticker", "d", F.sum("v").over(w).alias("flow"))
    own = Window.partitionBy("ticker", "owner").orderBy("d")
    buys = one.where("bought").select("ticker", "owner", "d", F.lead("d").over(own).alias("next"))
    until = F.least(F.date_add("d", days + 1), F.coalesce("next", F.date_add("d", days + 1)))
    steps = buys.select("ticker", F.explode(F.array(F.struct(F.col("d").alias("d"), F.lit(1).alias("c")), F.struct(until.alias("d"), F.lit(-1).alias("c")))).alias("x")).select("ticker", "x.d", "x.c")
    changes = steps.union(by_day.select("ticker", "d", F.lit(0))).groupBy("ticker", "d").agg(F.sum("c").alias("c"))
    upto = Window.partitionBy("ticker").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return flow.join(changes.select("ticker", "d", F.sum("c").over(upto).alias("buyers")), ["ticker", "d"])
