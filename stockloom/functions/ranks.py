"""Rank statistics with average ties, as window and aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """1-based rank within the partition; equal values share their mean rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)


def correlation(x: str, y: str, least: int = 3) -> Column:
    """Pearson's correlation as an aggregate; NULL below ``least`` pairs or without variance."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(F.when(both, 1)) >= least) & (spread > 1e-12), F.try_divide(F.covar_pop(a, b), spread))


def spearman_by(df: DataFrame, x: str, y: str, *by: str, least: int = 3) -> DataFrame:
    """One rank correlation (ic, n) for each group; rows with a missing side are left out first."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = pairs.select(*by, average_rank(x, *by).alias("__x"), average_rank(y, *by).alias("__y"))
    return ranked.groupBy(*by).agg(correlation("__x", "__y", least).alias("ic"), F.count("*").alias("n"))


def ic_summary(ics: DataFrame, *by: str, ic: str = "ic") -> DataFrame:
    """n, mean, sample sd (0 for one value), information ratio, t and hit rate of correlations."""
    agg = ics.where(F.col(ic).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(ic).alias("mean_ic"), F.coalesce(F.stddev_samp(ic), F.lit(0.0)).alias("sd_ic"), (F.count_if(F.col(ic) > 0) / F.count("*")).alias("hit_rate"))
    icir = F.when(F.col("sd_ic") > 0, F.try_divide(F.col("mean_ic"), F.col("sd_ic")))
    return agg.withColumn("icir", icir).withColumn("t_stat", icir * F.sqrt("n"))


def percentile_score(value: str, *by: str) -> Column:
    """0..100 by average rank; 50 for a group of one."""
    n = F.count("*").over(Window.partitionBy(*by))
    return F.when(n > 1, (average_rank(value, *by) - 1) / (n - 1) * 100).otherwise(50.0)


def mid_rank(value: str, *by: str) -> Column:
    """Average rank in (0, 1): (rank - 1/2) / n."""
    return (average_rank(value, *by) - 0.5) / F.count("*").over(Window.partitionBy(*by))
