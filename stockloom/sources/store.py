"""Stores that lose nothing: records are only ever added, under a version, and the newest version of a key is what is read.

A save touches no other record: not those of other names on the same day, nor the older versions of its own, so a save that is
interrupted leaves what was there. A version is written as a partition of its own; writing it once more (a replayed
micro-batch) replaces just that. Versions are numbers that grow: the clock for single saves, the batch number for a stream; one store takes
either the one or the other.

``accumulate`` and ``capture`` fill such a store once per name and day: names that a day has already are skipped, data of an earlier day
than the run's are refused, and every run leaves a row of counts.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.session import discard, written

#: Buckets over which the names of a store without days are dealt.
BUCKETS = 256
RUN_COLUMNS = ["captured", "thin", "gated", "skipped", "failed"]


def exists(spark: SparkSession, root: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def put(rows: DataFrame, root: str, version: int, by: list[str]) -> None:
    """Add rows as one version, partitioned by ``by`` so that readers prune."""
    out = rows.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy(*by, "version").parquet(root)


def records(spark: SparkSession, root: str) -> DataFrame | None:
    """Every version of every record; None where nothing was saved yet."""
    if not exists(spark, root):
        return None
    try:
        rows = spark.read.parquet(root)
    except AnalysisException as e:
        if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # only empty saves so far
            return None
        raise
    return rows.withColumn("version", F.col("version").cast("long"))


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the record of its newest version, without the version. Equal versions (a key twice in one save): the greater hash."""
    others = [c for c in rows.columns if c not in (*keys, "version")]
    best = F.max_by(F.struct(*others), F.struct("version", F.xxhash64(*others))) if others else F.max("version")
    return rows.groupBy(*keys).agg(best.alias("__x")).select(*keys, *([f"__x.{c}" for c in others]))


# ---------------------------------------------------------------- snapshots of (ticker, day)


def save_snapshots(rows: DataFrame, root: str, version: int | None = None) -> None:
    """One record per (ticker, day); saving a name's day again replaces that record and no other."""
    put(rows, f"{root}/records", time.time_ns() if version is None else version, ["day"])


def snapshots(spark: SparkSession, root: str, day: str | None = None) -> DataFrame:
    """The record of every (ticker, day), or of one day (by partition pruning)."""
    rows = records(spark, f"{root}/records")
    if rows is None:
        raise FileNotFoundError(f"no snapshots under {root}")
    return newest(rows.where(F.col("day") == F.lit(day).cast("date")) if day else rows, ["ticker", "day"])


def latest_snapshots(spark: SparkSession, root: str, day: str | None = None) -> DataFrame:
    """The newest day's record of every ticker, or those of one day exactly."""
    if day:
        return snapshots(spark, root, day)
    rows = records(spark, f"{root}/records")
    if rows is None:
        raise FileNotFoundError(f"no snapshots under {root}")
    others = [c for c in rows.columns if c not in ("ticker", "version")]
    best = F.max_by(F.struct(*others), F.struct("day", "version", F.xxhash64(*others)))
    return rows.groupBy("ticker").agg(best.alias("__x")).select("ticker", *[f"__x.{c}" for c in others])


def captured_days(spark: SparkSession, root: str) -> DataFrame:
    rows = records(spark, f"{root}/records")
    return spark.createDataFrame([], "ticker string, day date") if rows is None else rows.select("ticker", "day").distinct()


# ---------------------------------------------------------------- one capture per name and day


def _before(spark: SparkSession, root: str, version: int, since: Column) -> DataFrame | None:
    """(ticker, day) captured by other versions, from a day on."""
    rows = records(spark, f"{root}/records")
    return None if rows is None else rows.where((F.col("day") >= since) & (F.col("version") != version)).select("ticker", "day").distinct()


def accumulate(rows: DataFrame, root: str, today: str, fields: list[str], extra: list[str] | None = None, floor: float = 0.0, thin: float = 0.5, force: bool = False, version: int | None = None) -> DataFrame:
    """One run over names: ``rows`` has for each the day its data are of and its fields (NULL: not there; a name without a day has no
    snapshot). Returns ticker, outcome, coverage, and saves the captured and the thin ones.

    In this order: skipped, captured today before (unless ``force``); failed, no snapshot or one of an earlier day; gated, a share of
    fields below ``floor``; failed, nothing at all, ``extra`` fields included; thin, a share below ``thin``; captured.
    """
    spark, version = rows.sparkSession, time.time_ns() if version is None else version
    now = F.lit(today).cast("date")
    share = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0)) / F.lit(float(len(fields)))
    nothing = F.coalesce(*[F.col(f).cast("string") for f in [*fields, *(extra or [])]]).isNull()
    told = rows.withColumn("coverage", share)
    before = None if force else _before(spark, root, version, now)
    if before is None:
        told = told.withColumn("__had", F.lit(False))
    else:
        told = told.join(before.where(F.col("day") == now).select("ticker", F.lit(True).alias("__had")), "ticker", "left")
    outcome = F.when(F.col("__had"), "skipped").when(F.col("day").isNull() | (F.col("day") < now), "failed").when(F.col("coverage") < floor, "gated")
    told = written(told.withColumn("outcome", outcome.when(nothing, "failed").when(F.col("coverage") < thin, "thin").otherwise("captured")).drop("__had"))
    saved = told.where(F.col("outcome").isin("captured", "thin"))
    put(saved.drop("outcome", "coverage"), f"{root}/records", version, ["day"])
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in RUN_COLUMNS]
    kept = F.round(F.avg(F.when(F.col("outcome").isin("captured", "thin"), F.col("coverage"))), 3)
    run = told.agg(F.count("*").alias("attempted"), *counts, kept.alias("mean_coverage"))
    put(run.withColumn("day", now), f"{root}/runs", version, ["day"])
    return told.select("ticker", "outcome", "coverage")


def runs(spark: SparkSession, root: str) -> DataFrame:
    """The log: a row for each run."""
    return spark.read.parquet(f"{root}/runs")


def capture(batch: DataFrame, root: str, today: str, order: list[str], version: int) -> None:
    """Rows (ticker, day, ...) of one micro-batch: the first row in ``order`` of every name and day from ``today`` on is kept, unless the
    store has that day of the name; rows of earlier days go to the reject table. Skipped rows are only counted."""
    spark, now = batch.sparkSession, F.lit(today).cast("date")
    rows = written(batch)
    late = F.col("day") < now
    put(rows.where(late), f"{root}/rejects", version, [])
    others = [c for c in rows.columns if c not in ("ticker", "day")]
    first = rows.where(~late).groupBy("ticker", "day").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("x")).select("ticker", "day", "x.*")
    before = _before(spark, root, version, now)
    fresh = first if before is None else first.join(before, ["ticker", "day"], "left_anti")
    kept = written(fresh)
    put(kept, f"{root}/records", version, ["day"])
    run = rows.agg(F.count("*").alias("attempted"), F.count_if(late).alias("failed")).join(kept.agg(F.count("*").alias("captured")))  # one row each
    put(run.withColumn("skipped", F.col("attempted") - F.col("failed") - F.col("captured")), f"{root}/runs", version, [])
    discard(rows, kept)


def rejects(spark: SparkSession, root: str) -> DataFrame | None:
    """Refused rows, each once however often it arrived; None where none was."""
    rows = records(spark, f"{root}/rejects")
    return None if rows is None else rows.drop("version").distinct()


# ---------------------------------------------------------------- facts as they were known


FACT = ["cik", "tag", "fy_end"]


def fact_versions(facts: DataFrame) -> DataFrame:
    """Versions of facts (cik, tag, fy_end, filed, val) as intervals [known_from, known_to): what was known on a day stays what it was,
    whatever is filed later. Of two values filed on one day the smaller counts."""
    one = facts.groupBy(*FACT, "filed").agg(F.min("val").alias("val"))
    w = Window.partitionBy(*FACT).orderBy("filed")
    return one.select(*FACT, F.col("filed").alias("known_from"), F.lead("filed").over(w).alias("known_to"), F.row_number().over(w).alias("version_of_fact"), "val")


def extend_facts(batch: DataFrame, root: str, version: int) -> None:
    """Adds filed facts: the intervals of the facts that the batch names are put anew, old and new filings together, under the batch's
    version; facts that it doesn't name are not read beyond their bucket nor written."""
    spark = batch.sparkSession
    dealt = lambda df: df.withColumn("bucket", F.pmod(F.xxhash64("cik"), F.lit(BUCKETS)).cast("int"))
    new = dealt(batch.select(*FACT, "filed", "val"))
    known = facts_known(spark, root, before=version)
    if known is not None:
        touched = new.select("bucket", *FACT).distinct()
        new = new.unionByName(known.join(touched, ["bucket", *FACT], "left_semi").select("bucket", *FACT, F.col("known_from").alias("filed"), "val"))
    put(dealt(fact_versions(new)), root, version, ["bucket"])


def facts_known(spark: SparkSession, root: str, on: str | None = None, before: int | None = None) -> DataFrame | None:
    """Intervals as of the newest batch (or of batches before one), or the values known on a day."""
    rows = records(spark, root)
    if rows is None:
        return None
    rows = rows if before is None else rows.where(F.col("version") < before)
    last = F.max("version").over(Window.partitionBy("bucket", *FACT))
    rows = rows.withColumn("__last", last).where("version = __last").drop("__last", "version")
    if on is None:
        return rows
    day = F.lit(on).cast("date")
    return rows.where((F.col("known_from") <= day) & (F.col("known_to").isNull() | (F.col("known_to") > day))).select(*FACT, "val")
