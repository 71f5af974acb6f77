"""What the sources of a run delivered: statuses, gaps they explain, and the record kept beside a card."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions.sizes import small

#: Statuses that mark a problem, and the sub-scores whose absence is a gap, in order.
PROBLEMS = ("gated_402", "rate_limited_429", "empty", "error")
GAP_FIELDS = ("quality", "moat", "growth", "momentum", "value", "insider")

Source = Callable[[SparkSession, str], DataFrame]


class Sources:
    """Pluggable data sources: name -> function of (session, place) that returns a partial record (key and any fields). What
    they return is united, each row marked with its source; nothing is called per row."""

    def __init__(self) -> None:
        self.known: dict[str, Source] = {}
        self.no_data_is_normal: set[str] = set()
        self.feeds_no_axis: set[str] = set()

    def add(self, name: str, source: Source, no_data_is_normal: bool = False, feeds_axes: bool = True) -> None:
        if name in self.known:
            raise ValueError(f"source {name} is there already")
        self.known[name] = source
        if no_data_is_normal:
            self.no_data_is_normal.add(name)
        if not feeds_axes:
            self.feeds_no_axis.add(name)

    def rows(self, spark: SparkSession, place: str, names: list[str] | None = None) -> DataFrame:
        """All partial records, with missing fields as NULL."""
        out = None
        for name in names or list(self.known):
            got = self.known[name](spark, place).withColumn("source", F.lit(name))
            out = got if out is None else out.unionByName(got, allowMissingColumns=True)
        if out is None:
            raise ValueError("no source")
        return out

    def aux_only(self, names: list[str]) -> list[str]:
        """The known ones among ``names`` for which having nothing to report is normal."""
        return [n for n in names if n in self.no_data_is_normal]

    def axisless(self, names: list[str]) -> list[str]:
        """The known ones among ``names`` that feed no sub-score."""
        return [n for n in names if n in self.feeds_no_axis]


def statuses(outcomes: DataFrame, contributed: DataFrame, dimension: DataFrame) -> DataFrame:
    """ticker, source, status: an ok source of which no field came counts as empty, unless having none is normal for it
    (dimension: source, no_data_is_normal, feeds_axes; a small table, one row a source)."""
    gave = contributed.select("ticker", "source").distinct().withColumn("gave", F.lit(True))
    j = outcomes.join(gave, ["ticker", "source"], "left").join(small(dimension), "source", "left")
    nothing = (F.col("status") == "ok") & F.col("gave").isNull() & ~F.coalesce(F.col("no_data_is_normal"), F.lit(False))
    return j.select("ticker", "source", F.when(nothing, "empty").otherwise(F.col("status")).alias("status"), F.coalesce("feeds_axes", F.lit(True)).alias("feeds_axes"))


def unavailable(extra: Column | None = None) -> Column:
    """Sub-scores of a card that are missing and do apply to its sector; ``extra`` names a further missing field or is NULL."""
    masked = F.transform(F.filter("abstentions", lambda a: (a["scope"] == "subscore") & (a["reason"] == "inapplicable")), lambda a: a["field"])
    names = [F.when(F.col(n).isNull() & ~F.array_contains(masked, n), F.lit(n)) for n in GAP_FIELDS]
    return F.array_compact(F.array(*names, extra if extra is not None else F.lit(None).cast("string")))


def records(states: DataFrame, cards: DataFrame, extra: Column | None = None) -> DataFrame:
    """One record for each ticker with a source that is not ok: providers (source=status, sorted), unavailable (as the card
    says), note (the sources with a problem), axisless (sources that feed no sub-score)."""
    pair = F.concat_ws("=", "source", "status")
    bad = F.col("status").isin(*PROBLEMS)
    g = states.groupBy("ticker").agg(
        F.array_sort(F.collect_set(pair)).alias("providers"), F.array_sort(F.collect_set(F.when(bad, F.col("source")))).alias("flagged"),
        F.array_sort(F.collect_set(F.when(~F.col("feeds_axes"), F.col("source")))).alias("axisless"), F.bool_or(F.col("status") != "ok").alias("any"))  # sources are few
    note = F.when(F.size("flagged") > 0, F.concat(F.array_join("flagged", ", "), F.lit(": supplied no usable data for this symbol")))
    gaps = cards.select("ticker", unavailable(extra).alias("unavailable"))
    return g.where("any").join(gaps, "ticker", "left").select("ticker", "providers", "unavailable", note.alias("note"), "axisless")


def unexplained(states: DataFrame) -> DataFrame:
    """ticker, gaps: sources with a problem that could explain a missing sub-score; those that feed none cannot."""
    return states.groupBy("ticker").agg(F.array_sort(F.collect_set(F.when(F.col("status").isin(*PROBLEMS) & F.col("feeds_axes"), F.col("source")))).alias("gaps"))
