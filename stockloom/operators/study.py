"""Persistence study: does a high return on capital last? Cohorts, outcomes and fixed-effect regressions.

Rows are (firm, year, cell, roic, revenue). Every step is keyed by (year) or (firm, year); the bootstrap is one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions.columns import ratio
from stockloom.functions.ranks import mid_rank


def top_floor(rows: DataFrame, share: int = 5) -> DataFrame:
    """Per year the value at place floor(n / share) from the top; NULL below ``share`` firms."""
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("roic")))
    n = F.count("*").over(Window.partitionBy("year"))
    return rows.withColumn("p", place).withColumn("n", n).groupBy("year").agg(F.max(F.when((F.col("n") >= share) & (F.col("p") == F.floor(F.col("n") / share)), F.col("roic"))).alias("floor"))


def history(rows: DataFrame, floors: DataFrame, years: int = 4, least: int = 3) -> DataFrame:
    """track (share of the last years at or above the floor) and steadiness (minus the deviation of mid-ranks)."""
    marked = rows.join(floors, "year").select("firm", "year", (F.col("roic") >= F.col("floor")).cast("double").alias("held"), mid_rank("roic", "year").alias("pct"))
    asks = rows.select("firm", "year", F.explode(F.sequence(F.lit(1), F.lit(years))).alias("back")).withColumn("then", F.col("year") - F.col("back"))
    seen = asks.join(marked.select("firm", F.col("year").alias("then"), "held", "pct"), ["firm", "then"])
    return seen.groupBy("firm", "year").agg(F.count("*").alias("seen"), F.avg("held").alias("track"), (-F.stddev_pop("pct")).alias("steadiness")).where(F.col("seen") >= least)


def cohorts(rows: DataFrame, floors: DataFrame, ahead: int = 3) -> DataFrame:
    """Each firm-year with its state ``ahead`` years on: observed, gap (seen later) or exit; held; compounded revenue ratio."""
    later = rows.select("firm", (F.col("year") - ahead).alias("year"), F.col("roic").alias("later_roic"), F.col("revenue").alias("later_revenue"))
    last = rows.groupBy("firm").agg(F.max("year").alias("last_year"))
    end_floor = floors.select((F.col("year") - ahead).alias("year"), F.col("floor").alias("end_floor"))
    j = rows.join(later, ["firm", "year"], "left").join(last, "firm").join(end_floor, "year", "left")
    state = F.when(F.col("later_roic").isNotNull(), "observed").when(F.col("last_year") > F.col("year") + ahead, "gap").otherwise("exit")
    return j.select("firm", "year", "cell", "roic", "revenue", state.alias("state"), (F.col("later_roic") >= F.col("end_floor")).cast("double").alias("held"), ratio(F.col("later_revenue"), F.col("revenue")).alias("grown"))


def finish(rows: DataFrame) -> DataFrame:
    """Mid-rank of roic within the year, and growth against the year's median."""
    med = rows.groupBy("year").agg(F.median("grown").alias("mid"))
    return rows.join(med, "year").withColumn("rank", mid_rank("roic", "year")).withColumn("beat", F.col("grown") - F.col("mid")).drop("mid")


def within_slope(rows: DataFrame, y: str, x: str, *cell: str) -> DataFrame:
    """Slope of y on x with a fixed effect for each cell: centre both in the cell, then one regression through zero."""
    w = Window.partitionBy(*cell)
    both = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    c = both.select((F.col(y) - F.avg(y).over(w)).alias("dy"), (F.col(x) - F.avg(x).over(w)).alias("dx"))
    return c.agg(F.count("*").alias("n"), ratio(F.sum(F.col("dx") * F.col("dy")), F.sum(F.col("dx") * F.col("dx"))).alias("slope"))


def bootstrap(rows: DataFrame, y: str, x: str, reps: int, seed: int, *cell: str) -> DataFrame:
    """Cluster bootstrap by firm as one grouped job: a firm's Poisson(1) count in a replication comes from a digest of seed, replication
    and firm, so a rerun agrees, on any engine. Firm counts weigh cell means and moments, which every replication has anew. Returns the
    replications with a slope and those without, the slopes at 2.5 and 97.5 % in order, and their deviation."""
    both = rows.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select("firm", *cell, F.col(y).alias("y"), F.col(x).alias("x"))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("firm").cast("string"))), 1, 7), 16, 10).cast("double") / float(1 << 28)
    steps, total, p = [], 0.0, 0.36787944117144233
    for k in range(7):
        total += p
        steps.append(F.when(u > total, 1).otherwise(0))
        p /= k + 1
    drawn = both.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("w", sum(steps, F.lit(0))).where("w > 0")
    cells = drawn.groupBy("rep", *cell).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("x")).alias("sx"), F.sum(F.col("w") * F.col("y")).alias("sy"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("w") * F.col("x") * F.col("y")).alias("sxy"))
    slopes = cells.groupBy("rep").agg(ratio(F.sum(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")), F.sum(F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"))).alias("slope"))
    told = slopes.agg(F.array_sort(F.collect_list("slope")).alias("s"), F.count("slope").alias("reps"), F.count_if(F.col("slope").isNull()).alias("singular"), F.stddev_pop("slope").alias("se"))  # one slope a replication
    at = lambda q, less: F.get("s", (F.floor(F.col("reps") * q) - less).cast("int"))
    return told.select("reps", "singular", at(0.025, 0).alias("low"), at(0.975, 1).alias("high"), "se")


def tercile_spread(rows: DataFrame, x: str, y: str) -> DataFrame:
    third = F.when(F.col(x) < 1 / 3, "low").when(F.col(x) < 2 / 3, "mid").otherwise("high")
    return rows.groupBy(third.alias("third")).agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.avg(F.when(F.col("state") == "exit", 1.0).otherwise(0.0)).alias("exit_rate"))


def quality_gates(rows: DataFrame) -> DataFrame:
    """Per year: firms, and how many stand alone in their cell."""
    alone = F.count("*").over(Window.partitionBy("year", "cell"))
    return rows.withColumn("a", alone).groupBy("year").agg(F.count("*").alias("firms"), F.count_if(F.col("a") == 1).alias("alone"), F.count_if(F.col("revenue").isNull()).alias("no_revenue"))


def thirds(rows: DataFrame, value: str, by: str) -> DataFrame:
    """Cut values of thirds from mid-ranks in whole numbers: the smallest values with 3r >= 2n and 3r >= 4n, r = below + up to."""
    w = Window.partitionBy(by)
    below = F.rank().over(w.orderBy(value)) - 1
    upto = below + F.count("*").over(Window.partitionBy(by, value))
    r, n = below + upto, F.count("*").over(w)
    x = rows.select(by, value, r.alias("r"), n.alias("n"))
    return x.groupBy(by).agg(F.min(F.when(3 * F.col("r") >= 2 * F.col("n"), F.col(value))).alias("middle"), F.min(F.when(3 * F.col("r") >= 4 * F.col("n"), F.col(value))).alias("top"))


#: What a predictor must clear in the discovery and in the held-out window.
RULES = {"disc_min": 0.10, "disc_se": 2.0, "bound_min": 0.03, "hold_min": 0.06, "hold_se": 1.64, "sub_share": 0.5}


def pass_rules(measured: DataFrame, rule: dict[str, float] = RULES) -> DataFrame:
    """Measures of a predictor (beta, se, bound_held, bound_not, rank_beta, beta_sub; hold_beta, hold_se, hold_sub of the held-out window) with
    one column for each rule and ``passed``. A measure that is missing fails its rule."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    sub = lambda b, s: yes((F.col(b) > 0) & (F.col(s) >= rule["sub_share"] * F.col(b)))
    rules = {
        "magnitude": yes(F.col("beta") >= F.greatest(F.lit(rule["disc_min"]), rule["disc_se"] * F.col("se"))) & F.col("se").isNotNull(),
        "bounds": yes((F.col("bound_held") >= rule["bound_min"]) & (F.col("bound_not") >= rule["bound_min"])),
        "continuous_sign": yes(F.col("rank_beta") > 0),
        "sub_industry": sub("beta", "beta_sub"),
        "holdout": yes(F.col("hold_beta") >= F.greatest(F.lit(rule["hold_min"]), rule["hold_se"] * F.col("hold_se"))) & F.col("hold_se").isNotNull() & sub("hold_beta", "hold_sub"),
    }
    out = measured.withColumns(rules)
    return out.withColumn("passed", F.col("magnitude") & F.col("bounds") & F.col("continuous_sign") & F.col("sub_industry") & F.col("holdout"))


def reproduction_failures(sizes: DataFrame, expected: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """Years (year, n) whose size is off the expected one by more than a share of it; a missing year counts as 0."""
    j = expected.select("year", "expected").join(sizes.select("year", "n"), "year", "left").withColumn("got", F.coalesce("n", F.lit(0)))
    return j.where(F.abs(F.col("got") - F.col("expected")) > tolerance * F.col("expected")).select("year", "got", "expected")


def gap_spikes(rates: DataFrame, step: float = 0.05) -> DataFrame:
    """Years (year, rate) that stand more than a step above both neighbouring years; a year without both has none."""
    at = lambda n, name: rates.select((F.col("year") + n).alias("year"), F.col("rate").alias(name))
    j = rates.join(at(1, "before"), "year").join(at(-1, "after"), "year")
    return j.where((F.col("rate") - F.col("before") > step) & (F.col("rate") - F.col("after") > step)).select("year", "rate")


def data_checks(rows: DataFrame, least_assets: float = 0.0) -> DataFrame:
    """Per year of (year, cell, cell3, state, debt, revenue, assets): shares of rows alone in either cell (of those with a code), of no debt,
    counts without revenue although of some size, and shares of every state."""
    alone = lambda c: F.when(F.col(c).isNotNull(), (F.count("*").over(Window.partitionBy("year", c)) == 1).cast("double"))
    marked = rows.withColumn("__a", alone("cell")).withColumn("__b", alone("cell3"))
    share = lambda c: F.avg(c.cast("double"))
    states = [share(F.col("state") == s).alias(f"share_{s}") for s in ("observed", "low_ic", "gap", "exit")]
    return marked.groupBy("year").agg(F.avg("__a").alias("alone"), F.avg("__b").alias("alone_fine"), share(F.coalesce("debt", F.lit(0.0)) == 0).alias("zero_debt"), F.count_if(F.col("revenue").isNull() & (F.col("assets") >= least_assets)).alias("no_revenue"), *states)


def state_by_third(rows: DataFrame, x: str, state: str) -> DataFrame:
    """Share of rows in a state in the worst, middle and best third of a predictor."""
    third = F.when(F.col(x) < 1 / 3, "worst").when(F.col(x) < 2 / 3, "middle").otherwise("best")
    return rows.where(F.col(x).isNotNull()).groupBy(third.alias("third")).agg(F.avg((F.col("state") == state).cast("double")).alias("share"))
