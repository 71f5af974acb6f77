"""The streaming operators on events that land as files and are drained as streams; some also as batch twins on the same functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stockloom.bindings import view
from stockloom.catalog import register
from stockloom.session import checkpoint_dir
from stockloom.sources.store import newest, records, rejects
from stockloom.streaming import operators as O
from stockloom.streaming.mentions import mention_delta


def _news(s, d):
    return view(s, d, "news")


def _drained(s, d, form):
    """Events landed as files, with a last row long after all others that closes every window, read as a stream and drained."""
    place, news = f"{checkpoint_dir(s)}/landed-{uuid.uuid4().hex}", _news(s, d)
    last = news.agg(F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.max("ts") + F.expr("INTERVAL 90 DAYS"), F.lit("end"), F.lit(0.0))
    news.union(last).write.parquet(f"{place}/in")
    return O.run_once(form(s.readStream.schema(O.NEWS).parquet(f"{place}/in")), f"{place}/out", f"{place}/state").where(~F.col("ticker").eqNullSafe(-1))


@register("st01_deduplicated", "SELECT user_id AS ticker, event_type, ARG_MIN(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def dedup(s, d):
    return O.deduplicated(_news(s, d), ["ticker", "event_type"]).select("ticker", "event_type", "event_id")


@register("st02_daily_counts", "SELECT user_id AS ticker, CAST(ts AS DATE) AS day, COUNT(*) AS c, ROUND(SUM(value), 4) AS value FROM events GROUP BY ALL")
def daily(s, d):
    return _drained(s, d, O.daily_counts).withColumn("value", F.round("value", 4))


@register("st03_one_a_day", "SELECT user_id AS ticker, CAST(ts AS DATE) AS day, ARG_MIN(event_id, (ts, event_id)) AS event_id, ARG_MIN(event_type, (ts, event_id)) AS event_type FROM events GROUP BY ALL")
def one_a_day(s, d):
    return _drained(s, d, O.one_a_day)


@register("st04_stories", """WITH g AS (SELECT user_id AS ticker, ts, CASE WHEN ts >= LAG(ts) OVER w + INTERVAL 8 HOUR OR LAG(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, SUM(b) OVER (PARTITION BY ticker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS story FROM g) SELECT ticker, epoch_us(MIN(ts)) AS start_us, epoch_us(MAX(ts) + INTERVAL 8 HOUR) AS end_us, COUNT(*) AS n FROM s GROUP BY ticker, story""")
def stories(s, d):
    return _drained(s, d, lambda news: O.stories(news, "8 hours")).select("ticker", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), F.unix_micros(F.col("end").cast("timestamp")).alias("end_us"), "n")


@register("st05_mention_delta", "WITH x AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS day, COUNT(*) AS c FROM events GROUP BY ALL) SELECT x.ticker, x.day, x.c, x.c - y.c AS delta FROM x LEFT JOIN x y ON y.ticker = x.ticker AND y.day = x.day - 1")
def delta(s, d):
    return O.mention_delta(O.daily_counts(_news(s, d))).select("ticker", "day", "c", "delta")


@register("st05b_streamed_delta", "WITH x AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS day, COUNT(*) AS c FROM events GROUP BY ALL) SELECT x.ticker, x.day, x.c, x.c - y.c AS delta FROM x LEFT JOIN x y ON y.ticker = x.ticker AND y.day = x.day - 1")
def streamed_delta(s, d):
    """The same on a stream: events land in parcels of some days, errors always a parcel late, and a closing row ends the feed."""
    place = f"{checkpoint_dir(s)}/landed-{uuid.uuid4().hex}"
    news = _news(s, d).select("ticker", "ts", "event_type")
    edges = ["1900-01-01", "2024-01-11", "2024-01-21", "2100-01-01"]
    inside = lambda i: f"ts >= '{edges[i]}' and ts < '{edges[i + 1]}'"
    parts = [f"event_type <> 'error' and {inside(0)}", f"(event_type <> 'error' and {inside(1)}) or (event_type = 'error' and {inside(0)})", f"({inside(2)}) or (event_type = 'error' and {inside(1)})"]
    for i, part in enumerate(parts):
        parcel = news.where(part)
        if i == len(parts) - 1:
            parcel = parcel.union(news.agg(F.lit(-1).cast("long"), F.max("ts") + F.expr("INTERVAL 60 DAYS"), F.lit("end")))
        parcel.write.mode("append").parquet(f"{place}/in")
        stream = s.readStream.schema("ticker long, ts timestamp, event_type string").parquet(f"{place}/in")
        got = O.run_once(mention_delta(stream, "21 days"), f"{place}/out", f"{place}/state")
    return got.where(~F.col("ticker").eqNullSafe(-1)).select("ticker", "day", "c", "delta")


@register("st06_rolling_flow", """WITH x AS (SELECT o_custkey % 50 AS ticker, CAST(o_orderdate AS DATE) AS d, ROUND(SUM(o_totalprice), 2) AS v FROM orders GROUP BY ALL)
SELECT ticker, d, ROUND(SUM(v) OVER (PARTITION BY ticker ORDER BY d RANGE BETWEEN INTERVAL 183 DAY PRECEDING AND CURRENT ROW), 2) AS flow FROM x""")
def rolling(s, d):
    """The daily table rolled up over 183 days by a batch window."""
    from pyspark.sql import Window

    x = view(s, d, "insider").groupBy("ticker", "d").agg(F.round(F.sum("value"), 2).alias("v"))
    w = Window.partitionBy("ticker").orderBy(F.unix_date("d")).rangeBetween(-183, 0)
    return x.select("ticker", "d", F.round(F.sum("v").over(w), 2).alias("flow"))


@register("st07_daily_capture", """WITH e AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS day, ts, event_id FROM events)
SELECT 'kept' AS kind, ticker, day, ARG_MIN(event_id, (ts, event_id)) AS event_id, 1 AS n FROM e WHERE day >= DATE '2024-01-15' GROUP BY ALL
UNION ALL SELECT 'refused', ticker, day, ARG_MIN(event_id, (ts, event_id)), COUNT(*) FROM e WHERE day < DATE '2024-01-15' GROUP BY ALL""")
def capture(s, d):
    """Events land in three parcels, the second with some that came before and the third with more late ones; each is drained by a
    stream that keeps the first event of every name and day and refuses days before the run's."""
    place = f"{checkpoint_dir(s)}/landed-{uuid.uuid4().hex}"
    news = _news(s, d).withColumn("day", F.to_date("ts"))
    parcels = ["ts < '2024-01-20'", "ts >= '2024-01-18' and ts < '2024-01-25'", "ts >= '2024-01-25' or ts < '2024-01-10'"]
    for parcel in parcels:
        news.where(parcel).write.mode("append").parquet(f"{place}/in")
        stream = s.readStream.schema(f"{O.NEWS}, day date").parquet(f"{place}/in")
        O.captured(stream, f"{place}/out", f"{place}/state", "2024-01-15", ["ts", "event_id"])
    kept = newest(records(s, f"{place}/out/records"), ["ticker", "day"]).select(F.lit("kept").alias("kind"), "ticker", "day", "event_id", F.lit(1).cast("long").alias("n"))
    late = rejects(s, f"{place}/out").groupBy("ticker", "day").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n"))
    return kept.unionByName(late.select(F.lit("refused").alias("kind"), "ticker", "day", "event_id", "n"))


@register("st09_enriched", "SELECT event_id, user_id AS ticker, CASE WHEN CAST(ts AS DATE) < DATE '2024-01-16' THEN 'old' ELSE 'new' END AS name FROM events")
def enrich(s, d):
    names = _news(s, d).select("ticker").distinct()
    cut = F.lit("2024-01-16").cast("date")
    directory = names.select("ticker", F.lit("2000-01-01").cast("date").alias("from_day"), cut.alias("to_day"), F.lit("old").alias("name")).union(names.select("ticker", cut, F.lit(None).cast("date"), F.lit("new")))
    return O.enriched(_news(s, d), directory).select("event_id", "ticker", "name")
