"""Peer groups and portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.columns import ratio


#: Fixed value: the form of a vendor's peer ticker.
PEER_TICKER = r"^[A-Z0-9][A-Z0-9.\\-]{0,9}$"


def peer_list(vendor: DataFrame) -> DataFrame:
    """ticker, peer, pos: from vendor lists (ticker, peers array), the distinct well-formed peers other than the name itself, in
    the vendor's order."""
    rows = vendor.select(F.upper("ticker").alias("ticker"), F.posexplode("peers").alias("pos", "raw")).withColumn("peer", F.upper(F.trim("raw")))
    good = rows.where(F.col("peer").rlike(PEER_TICKER) & (F.col("peer") != F.col("ticker")))
    first = good.groupBy("ticker", "peer").agg(F.min("pos").alias("at"))
    return first.select("ticker", "peer", F.row_number().over(Window.partitionBy("ticker").orderBy("at")).alias("pos"))


def usable(candidates: DataFrame, floor: float) -> DataFrame:
    """Candidates (ticker, peer, pos, cap, growth, own_cap, own_growth) with a market value at or above the floor that are no
    share class of the name or of a peer kept before: equal value and equal growth, nulls never equal."""
    real = candidates.where(F.col("cap") >= floor)
    twin = (F.col("cap") == F.col("own_cap")) & (F.col("growth") == F.col("own_growth"))
    others = real.where(~F.coalesce(twin, F.lit(False)))
    nth = F.row_number().over(Window.partitionBy("ticker", "cap", "growth").orderBy("pos"))
    return others.withColumn("__n", nth).where(F.col("growth").isNull() | (F.col("__n") == 1)).drop("__n")


def closest_in_size(members: DataFrame, k: int) -> DataFrame:
    """For each name the k others of its group closest in log size (the gap to nine figures, then by ticker); nth, and place from
    the largest down. Sizes fall into bins of a billionth. A gap is within one bin of the distance of the bins, so the k nearest
    lie in the k + 2 filled bins below and above a name's own; of names equal in size the first k + 1 are enough. No pairs
    of a group are formed."""
    a = members.where(F.col("cap") > 0).select("sector", "ticker", "cap", F.ln("cap").alias("size")).withColumn("bin", F.floor(F.col("size") * 1e9))
    nth = F.row_number().over(Window.partitionBy("sector", "size").orderBy("ticker"))
    firsts = a.withColumn("__n", nth).where(F.col("__n") <= k + 1).groupBy("sector", "bin").agg(F.collect_list(F.struct("ticker", "cap", "size")).alias("names"))  # at most k + 1 of a size
    around = Window.partitionBy("sector").orderBy("bin").rowsBetween(-k - 2, k + 2)
    near = firsts.select("sector", "bin", F.flatten(F.collect_list("names").over(around)).alias("near"))  # 2k + 5 bins
    pairs = a.join(near, ["sector", "bin"]).select("sector", "ticker", "cap", "size", F.explode("near").alias("p")).where(F.col("ticker") != F.col("p.ticker"))
    pairs = pairs.select("sector", "ticker", "cap", F.col("p.ticker").alias("peer"), F.col("p.cap").alias("peer_cap"), F.round(F.abs(F.col("size") - F.col("p.size")), 9).alias("gap"))
    kept = pairs.withColumn("nth", F.row_number().over(Window.partitionBy("ticker").orderBy("gap", "peer"))).where(F.col("nth") <= k)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("peer_cap"), "nth")))


def meaningful(value: Column, kind: str, nonneg: bool) -> Column:
    """A negative value of such a measure says nothing; zero does not either for a multiple."""
    return F.when(value > 0 if kind == "multiple" else value >= 0, value) if nonneg else value


def measure_rows(peers: DataFrame, values: DataFrame, measures: list[str], low_first: tuple[str, ...] = (), positive: tuple[str, ...] = (), nonneg: tuple[str, ...] = ()) -> DataFrame:
    """ticker, measure, own, median of the peers that report it, rank among those peers and self (ties share the better; low
    end first for ``low_first``), usable peers, not_meaningful (the own value is there but says nothing: ``positive`` and
    ``nonneg`` measures). No rank without an own value or without peers."""
    kept = [meaningful(F.col(m), "multiple" if m in positive else "", m in positive or m in nonneg).cast("double").alias(m) for m in measures]
    wide = values.select("ticker", *kept).unpivot("ticker", measures, "measure", "value")
    raw = values.select("ticker", *[F.col(m).cast("double").alias(m) for m in measures]).unpivot("ticker", measures, "measure", "raw")
    own = peers.select("ticker").distinct().join(wide, "ticker").withColumnRenamed("value", "own").join(raw, ["ticker", "measure"])
    theirs = peers.select("ticker", "peer").join(wide.select(F.col("ticker").alias("peer"), "measure", "value"), "peer")
    both = own.join(theirs.select("ticker", "measure", "value"), ["ticker", "measure"], "left")
    ahead = F.when(F.col("measure").isin(list(low_first)), F.col("value") < F.col("own")).otherwise(F.col("value") > F.col("own"))
    g = both.groupBy("ticker", "measure", "own", "raw").agg(F.median("value").alias("median"), F.count_if(ahead).alias("ahead"), F.count("value").alias("usable"))
    place = F.when(F.col("own").isNotNull() & (F.col("usable") > 0), F.col("ahead") + 1)
    return g.select("ticker", "measure", "own", "median", place.alias("place"), "usable", (F.col("own").isNull() & F.col("raw").isNotNull()).alias("not_meaningful"))


def relative(own: Column, peers_median: Column, usable_: Column, market: Column, least: int, rule: float = 5.0) -> Column:
    """Split of a return (points) as a struct (gap, shared, verdict): its gap to the peers' median, and the median's own gap to
    the market (to zero where that is unknown); the larger part names the move, both under the rule are small. NULL below
    ``least`` peers or without an own return."""
    gap, shared = own - peers_median, peers_median - F.coalesce(market, F.lit(0.0))
    verdict = F.when((F.abs(gap) < rule) & (F.abs(shared) < rule), "small").when(F.abs(gap) >= F.abs(shared), "own").otherwise("shared")
    return F.when(own.isNotNull() & (usable_ >= least), F.struct(gap.alias("gap"), shared.alias("shared"), verdict.alias("verdict")))


def median_of_others(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """by, key, value, med, n: for each row the median of the other rows' values of its group, and how many there are. Rows
    are placed once; the two middle places among the others follow from the own place, so no pairs are formed."""
    w = Window.partitionBy(*by)
    placed = rows.select(*by, key, value, F.row_number().over(w.orderBy(value, key)).alias("p"), (F.count("*").over(w) - 1).alias("n"))
    skip = lambda at: at + F.when(F.col("p") <= at, 1).otherwise(0)
    low, high = skip(F.floor((F.col("n") + 1) / 2)), skip(F.floor((F.col("n") + 2) / 2))
    asked = placed.withColumn("lo", low.cast("int")).withColumn("hi", high.cast("int"))
    at = placed.select(*by, F.col("p").alias("q"), F.col(value).alias("v"))
    one = asked.join(at.withColumnsRenamed({"q": "lo", "v": "v1"}), [*by, "lo"], "left").join(at.withColumnsRenamed({"q": "hi", "v": "v2"}), [*by, "hi"], "left")
    return one.select(*by, key, value, F.when(F.col("n") > 0, (F.col("v1") + F.col("v2")) / 2).alias("med"), "n")


def combined_growth(cap: Column, price_to_sales: Column, growth: Column) -> Column:
    """Growth of all peers' revenue together (aggregate): sales from value over price-to-sales, last year's from the growth."""
    sales = F.when((price_to_sales > 0) & (growth > -1), cap / price_to_sales)
    return F.try_divide(F.sum(sales), F.sum(F.when(sales.isNotNull(), sales / (1 + growth)))) - 1


def weights(holdings: DataFrame) -> DataFrame:
    """Weight within the portfolio; unpriced holdings have none. Shorts count negative, so the rest may exceed 1."""
    total = F.sum("value").over(Window.partitionBy("portfolio"))
    return holdings.withColumn("weight", F.when(total > 0, ratio(F.col("value"), total)))


def summary(weighted: DataFrame, cards: DataFrame) -> DataFrame:
    """Per portfolio: holdings, value, weighted composite over those with a card, names without one, tripped gates."""
    j = weighted.join(cards, "ticker", "left")
    has = F.col("composite").isNotNull()
    return j.groupBy("portfolio").agg(F.count("*").alias("holdings"), F.sum("value").alias("value"), ratio(F.sum(F.when(has, F.col("weight") * F.col("composite"))), F.sum(F.when(has, F.col("weight")))).alias("composite"), F.count_if(~has).alias("without_card"), F.count_if(F.size("gates") > 0).alias("gated"))


def mix(weighted: DataFrame, sectors: DataFrame) -> DataFrame:
    return weighted.join(sectors, "ticker", "left").groupBy("portfolio", F.coalesce("sector", F.lit(-1)).alias("sector")).agg(F.sum("weight").alias("weight"))
