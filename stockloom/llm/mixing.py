"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source, in an order shuffled by a hash of its doc_id, gets a virtual finish time: the
source's words up to and including it, divided by the source's target. A second and third pass over a
source follow with its whole size added. All copies in order of finish time are taken until the budget,
the total of all sizes, is spent. Targets share the budget by weight (1, 2, 3, repeating, by source in
code-point order, null last); none exceeds three times its source, and the excess is reshared.

Both orders are range sorts over all rows: the documents by source and shuffled place, whose running sums less those of the
sources before give the finish times, and all copies by finish time, whose running sums are cut at the budget. No source, no
bin and no time is gathered anywhere; rows that agree in all else are dealt by their own number.

Edge cases: null text has size 0 and taken 0; a null source is a source of its own; a null doc_id is told apart by its text, and rows
that repeat doc_id and text stand next to each other; equal finish times are taken in the shuffled order; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions.ordered import numbered, running
from stockloom.llm import shared

WORD = r"[^\x20\x09-\x0D]+"
PASSES = 3


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, key (the source, never null), size, mark (shuffled order)."""
    source, text, id_ = F.col("source").cast("string"), F.col("text").cast("string"), F.col("doc_id").cast("long")
    return documents.select(
        id_.alias("doc_id"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))).alias("mark"),
    )


def targets(by_source: DataFrame) -> DataFrame:
    """key, source_size, target: one row per source. The water level fills sources in order of cap over weight; both orders, by
    key and by that quotient, are range partitions, so millions of sources are no single task."""
    ranked = numbered(by_source, [F.col("key")], "nth").withColumn("w", ((F.col("nth") - 1) % 3 + 1).cast("int")).withColumn("cap", PASSES * F.col("source_size"))
    ranked = shared.written(ranked.select("key", "source_size", "w", "cap", (F.col("cap").cast("double") / F.col("w").cast("double")).alias("full_at")))
    all_ = F.broadcast(ranked.agg(F.sum("source_size").alias("total"), F.sum("w").alias("weights")))  # one row
    rising = running(ranked, [F.col("full_at"), F.col("key")], caps=F.col("cap"), upto=F.col("w"))
    left, weight = F.col("total") - (F.col("caps") - F.col("cap")), F.col("weights") - (F.col("upto") - F.col("w"))
    levels = rising.join(all_).withColumn("level", left.cast("double") / weight.cast("double"))
    level = F.broadcast(levels.agg(F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "key", "level")))["level"].alias("level")))  # one row
    target = F.when(F.col("full_at") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w").cast("double"))
    return ranked.join(level).select("key", "source_size", target.alias("target"))


def mix(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    docs = shared.written(sizes(documents).withColumn("row", F.monotonically_increasing_id()))
    by_source = shared.written(docs.groupBy("key").agg(F.sum("size").alias("source_size")))
    before = running(by_source, [F.col("key")], upto=F.col("source_size")).select("key", (F.col("upto") - F.col("source_size")).alias("before"))
    goal = shared.written(targets(by_source).join(before, "key"))
    placed = shared.join_ids(running(docs, [F.col("key"), F.col("mark"), F.col("row")], place=F.col("size")), goal, "key", "inner")
    within = F.col("place") - F.col("before")
    passes = F.array(*[(F.lit(i) * F.col("source_size") + within).cast("double") / F.col("target") for i in range(PASSES)])
    copies = placed.select("row", "mark", "doc_id", "size", "source_size", "target", F.posexplode(F.when(F.col("size") > 0, passes).otherwise(F.array(F.lit(0.0)))).alias("copy", "at"))
    queue = running(copies, [F.col("at"), F.col("mark"), F.col("row"), F.col("copy")], spent=F.col("size"))
    budget = docs.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("budget"))
    taken = F.sum(F.when(F.col("spent") <= F.col("budget"), F.col("size")).otherwise(0)).cast("long")
    return queue.join(F.broadcast(budget)).groupBy("row", "doc_id", "size", "source_size", "target").agg(taken.alias("taken")).drop("row")  # a row's own copies; budget is one row


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(shared.read(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || md5(COALESCE(text, ''))) AS mark, ROW_NUMBER() OVER () AS rn
  FROM documents),
s AS (SELECT key, SUM(size)::BIGINT AS source_size FROM d GROUP BY key),
r AS (SELECT *, (ROW_NUMBER() OVER (ORDER BY key) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
f AS (SELECT *, CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) AS full_at FROM r),
l AS (SELECT *, CAST(SUM(source_size) OVER () - (SUM(cap) OVER (ORDER BY full_at, key) - cap) AS DOUBLE)
              / CAST(SUM(w) OVER () - (SUM(w) OVER (ORDER BY full_at, key) - w) AS DOUBLE) AS level FROM f),
v AS (SELECT level AS lam FROM l WHERE level <= full_at ORDER BY full_at, key LIMIT 1),
t AS (SELECT key, source_size, CASE WHEN full_at <= lam THEN CAST(cap AS DOUBLE) ELSE lam * CAST(w AS DOUBLE) END AS target FROM f, v),
u AS (SELECT rn, mark, doc_id, size, source_size, target,
             CAST(SUM(size) OVER (PARTITION BY key ORDER BY mark, rn) AS BIGINT) AS upto FROM d JOIN t USING (key)),
c AS (SELECT rn, mark, size, n, CAST(n * source_size + upto AS DOUBLE) / target AS fin FROM u, (VALUES (0), (1), (2)) x(n) WHERE size > 0),
g AS (SELECT rn, size, SUM(size) OVER (ORDER BY fin, mark, rn, n) AS spent FROM c),
k AS (SELECT rn, SUM(size)::BIGINT AS taken FROM g WHERE spent <= (SELECT SUM(size) FROM d) GROUP BY rn)
SELECT doc_id, size, source_size, target, COALESCE(taken, 0)::BIGINT AS taken FROM u LEFT JOIN k USING (rn)
"""
