"""Scores: banded legs, sub-scores, composite, gates, flags and ranking, as one projection without a shuffle before the rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.columns import band, mean_present, weighted_present
from stockloom.functions.ordered import numbered
from stockloom.operators.fundamentals import decayed

#: Bands [lo, hi] of the legs; falling where hi < lo.
BANDS = {
    "roe": (0.10, 0.35), "net_margin": (0.00, 0.30), "interest_coverage": (2.0, 15.0), "debt_to_equity": (3.0, 0.0), "net_debt_to_ebitda": (6.0, 0.0),
    "gross_margin": (0.20, 0.70), "gross_margin_stability": (0.50, 1.00), "roic": (0.05, 0.30),
    "revenue_cagr": (0.00, 0.20), "fcf_cagr": (0.00, 0.20), "eps_cagr": (0.00, 0.20), "revenue_growth_persistence": (0.50, 1.00),
    "price_vs_200dma": (-0.10, 0.30), "rel_strength_6m": (-0.15, 0.25), "eps_revision": (-0.05, 0.10), "sue": (-2.0, 2.0), "residual_momentum": (-1.0, 1.0),
    "pct_to_52w_high": (0.70, 1.00), "max_daily_return": (0.15, 0.02), "vol_scaled_momentum": (0.0, 2.0),
    "upside_to_target": (0.00, 0.40), "fcf_yield": (0.02, 0.08), "ebit_ev_yield": (0.04, 0.12), "pe_vs_history": (-0.20, 0.30), "peg": (3.0, 0.5), "piotroski_f": (0.34, 1.00),
    "insider_sentiment": (-0.30, 0.30), "insider_net_ratio": (-0.0005, 0.0005), "insider_cluster": (1.0, 4.0), "insider_role_buy_ratio": (0.0, 0.001),
    "realized_vol": (0.45, 0.15), "max_drawdown": (-0.50, -0.10), "share_count_cagr": (0.04, -0.04), "asset_growth": (0.30, -0.10), "accruals": (0.15, -0.15), "shareholder_yield": (-0.02, 0.10),
}
#: The configuration a screen starts from. Every part may be changed: see ``configured``.
CONFIG = {
    "thresholds": BANDS,
    "weights": {"quality": 0.18, "moat": 0.18, "growth": 0.135, "value": 0.22, "momentum": 0.08, "insider": 0.135, "risk": 0.0},
    "quality": {"dilution": False, "asset_growth": False, "accruals": False},
    "momentum": {"sue": False, "residual": True},
    "sue": {"sigma_floor": 1.0, "decay_days": 60.0, "min_quarters": 3},
    "value": {"upside_to_target": True, "shareholder_yield": False},
    "insider": {"conviction": False, "planned_sell_discount": 1.0},
    "gates": {
        "min_market_cap": 3.0e8, "max_debt_to_equity": 5.0, "min_insider_sentiment": -0.60, "excuse_min_revenue_cagr": 0.15, "excuse_min_persistence": 0.70,
        "max_net_debt_to_ebitda": 4.0, "min_ebitda_margin": 0.03, "dte_artifact_ceiling": 20.0, "min_interest_coverage": 2.0},
    "validity": {"min_valid_leg_fraction": 0.5, "unknown_min_present_legs": 1, "min_scored_weight": 0.25, "min_composite_components": 1},
    "flags": {
        "crowded_short": {"min_short": 0.10, "min_days": 5.0, "max_age": 35}, "insider_cluster_buy": {"min_distinct": 3}, "planned_sale": {"min_value": 1}, "dilution": {"min_share_cagr": 0.03}, "cash_burn": {},
        "social_hype": {"min_mentions": 50, "min_delta": 0.5, "max_age": 2}, "news_spike": {"min_count": 10, "max_age": 3}, "filing_text_change": None,
        "value_trap": {"min_value": 60, "max_quality": 40, "max_growth": 40, "suppress_at": None, "confirm_at": None, "min_legs": 4},
        "risk_off_regime": {"max_net_debt_to_ebitda": 3.0, "max_debt_to_equity": 1.5, "cyclical_buckets": []}},
    "ranking": {"thin_below": None},
}
#: Flags that a filing stream raises by its presence; components of the composite in order; masks of sector buckets.
FILING_FLAGS = (
    "activist_13d", "recent_8k", "passive_13g", "planned_insider_sale_144", "late_filing", "shelf_offering", "sec_comment_letter", "restatement_8k", "auditor_change", "listing_deficiency")
COMPONENTS = ("quality", "moat", "growth", "momentum", "value", "insider")
MASKED_LEGS = ("gross_margin", "gross_margin_stability", "roic", "fcf_yield", "fcf_cagr", "interest_coverage", "debt_to_equity", "piotroski_f", "asset_growth", "accruals", "shareholder_yield")
MASKED_GATES = ("negative_fcf", "over_leveraged")
BUCKETS = [("reit", [(6798, 6798)]), ("insurer", [(6300, 6399), (6411, 6411)]), ("financials", [(6020, 6099), (6120, 6179), (6199, 6199), (6211, 6211), (6712, 6712)])]


def configured(**changes: dict) -> dict:
    """The configuration with some blocks changed, key by key: ``configured(value={"upside_to_target": False})``. A flag or a
    threshold set to None is off."""
    return {block: {**CONFIG[block], **changes.get(block, {})} for block in CONFIG}


def legs(config: dict = CONFIG) -> dict[str, tuple[str, ...]]:
    """Names of the legs of every sub-score; an optional one needs its switch and its band."""
    has = lambda name: config["thresholds"].get(name) is not None
    extra = lambda block, switch, name: (name,) if config[block].get(switch) and has(name) else ()
    return {
        "quality": ("roe", "net_margin", "interest_coverage", "debt_to_equity", *extra("quality", "dilution", "share_count_cagr"), *extra("quality", "asset_growth", "asset_growth"), *extra("quality", "accruals", "accruals")),
        "moat": ("gross_margin", "gross_margin_stability", "roic"),
        "growth": ("revenue_cagr", "fcf_cagr", "eps_cagr", "revenue_growth_persistence"),
        "momentum": ("price_vs_200dma", "rel_strength_6m", "eps_revision", *extra("momentum", "sue", "sue"), *extra("momentum", "residual", "residual_momentum")),
        "value": (*extra("value", "upside_to_target", "upside_to_target"), "fcf_yield", "pe_vs_history", "peg", *extra("value", "shareholder_yield", "shareholder_yield")),
        "insider": ("insider_sentiment", "insider_net_ratio"),
        "risk": ("realized_vol", "max_drawdown"),
    }


LEGS = legs()
WEIGHTS = {n: CONFIG["weights"][n] for n in COMPONENTS}


def bucket(sic: Column, buckets: list = BUCKETS) -> Column:
    """First bucket with a range that holds the code; other for the rest; unknown where there is none."""
    out = F.when(sic.isNull(), "unknown")
    for name, ranges in buckets:
        inside = F.lit(False)
        for lo, hi in ranges:
            inside = inside | sic.between(lo, hi)
        out = out.when(inside, name)
    return out.otherwise("other")


def masked(bucket_: Column, names: tuple[str, ...], name: str) -> Column:
    return bucket_.isin(*[b for b, _ in BUCKETS]) if name in names else F.lit(False)


def _input(df: DataFrame, name: str) -> Column:
    """A metric as a number, NaN and an absent column as NULL."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


def prepared(df: DataFrame, config: dict = CONFIG) -> DataFrame:
    """Metrics with the legs' derived inputs: PEG only of a positive P/E, long-run ROIC before the last, per-share growth where
    dilution counts, decayed surprise, insider flow over market value (planned sales given back under conviction)."""
    c = lambda n: _input(df, n)
    new = {}
    if "peg" in df.columns:
        new["peg"] = F.when((c("peg") > 0) & (c("pe_ttm") > 0), c("peg"))
    if "roic_5y_avg" in df.columns:
        new["roic"] = F.coalesce(c("roic_5y_avg"), c("roic"))
    if config["quality"].get("dilution") and "eps_cagr_ps" in df.columns:
        new["eps_cagr"] = F.coalesce(c("eps_cagr_ps"), c("eps_cagr"))
    if "last_surprise" in df.columns:
        rule = config["sue"]
        new["sue"] = F.when(c("earnings_quarters") >= rule["min_quarters"], decayed(c("last_surprise"), c("surprise_dispersion"), c("days_since_report"), rule["decay_days"], rule["sigma_floor"]))
    if "insider_net_6m" in df.columns:
        given = config["insider"]["planned_sell_discount"] * F.coalesce(c("insider_planned_sell_value"), F.lit(0.0)) if config["insider"].get("conviction") else F.lit(0.0)
        new["insider_net_ratio"] = F.when(c("market_cap") != 0, F.try_divide(c("insider_net_6m") + given, c("market_cap")))
    return df.withColumns(new) if new else df


def leg(df: DataFrame, name: str, config: dict = CONFIG) -> Column:
    """Banded value of a leg; NULL where its input or its band is not there."""
    limits = config["thresholds"].get(name)
    return band(_input(df, name), *limits) if limits is not None else F.lit(None).cast("double")


def axes(df: DataFrame, config: dict = CONFIG) -> list[Column]:
    """Single legs as signals of their own, for validation: every one NULL where its input is missing; and the value sub-score with
    the earnings yield added."""
    names = (
        "share_count_cagr", "asset_growth", "accruals", "shareholder_yield", "sue", "residual_momentum", "pct_to_52w_high", "max_daily_return", "vol_scaled_momentum", "price_vs_200dma",
        "rel_strength_6m", "net_debt_to_ebitda", "ebit_ev_yield", "fcf_yield", "pe_vs_history", "piotroski_f")
    wide = mean_present(*[leg(df, x, config) for x in ("upside_to_target", "fcf_yield", "pe_vs_history", "peg", "ebit_ev_yield")])
    return [*[leg(df, n, config).alias(f"{n}_axis") for n in names], wide.alias("value_plus_evebit_axis")]


def sub_score(df: DataFrame, name: str, config: dict = CONFIG) -> tuple[Column, Column]:
    """(score, reason why there is none): the mean of the applicable legs that are there, if they are enough. The insider and
    risk scores are never masked and need one leg."""
    b, rule, names = F.col("bucket"), config["validity"], legs(config)[name]
    if name in ("insider", "risk"):
        base = mean_present(*[leg(df, x, config) for x in names])
        if name == "insider" and config["insider"].get("conviction"):
            more = mean_present(band(_input(df, "insider_distinct_buyers"), *config["thresholds"]["insider_cluster"]), band(F.try_divide(_input(df, "insider_role_weighted_buy_value"), F.when(_input(df, "market_cap") != 0, _input(df, "market_cap"))), *config["thresholds"]["insider_role_buy_ratio"]))
            base = F.when(base.isNotNull() & more.isNotNull(), F.greatest(base, (base + more) / 2)).otherwise(base)  # buying may only raise
        return base, F.when(base.isNull(), "missing")
    parts = [(leg(df, x, config), masked(b, MASKED_LEGS, x)) for x in names]
    values = [F.when(~hidden, v) for v, hidden in parts]
    applicable = sum((F.when(hidden, 0).otherwise(1) for _, hidden in parts), F.lit(0))
    there = sum((F.when(v.isNotNull(), 1).otherwise(0) for v in values), F.lit(0))
    enough = F.when(b == "unknown", there >= rule["unknown_min_present_legs"]).otherwise(there >= rule["min_valid_leg_fraction"] * applicable) & (there > 0)
    return F.when(enough, mean_present(*values)), F.when(applicable == 0, "inapplicable").when(~enough, "missing")


def _named(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull())


def gates(df: DataFrame, config: dict = CONFIG) -> Column:
    """Names of the tripped gates; every gate opens where its input is missing."""
    c, g, b = lambda n: _input(df, n), config["gates"], F.col("bucket")
    excused = (c("revenue_cagr") >= g["excuse_min_revenue_cagr"]) & (c("revenue_growth_persistence") >= g["excuse_min_persistence"])
    usable = (c("ebitda") > 0) & (c("revenue") != 0) & (F.try_divide(c("ebitda"), c("revenue")) >= g["min_ebitda_margin"]) & c("net_debt_to_ebitda").isNotNull()
    served = F.coalesce(c("interest_coverage") >= g["min_interest_coverage"], F.lit(False))
    by_equity = (c("debt_to_equity") > g["max_debt_to_equity"]) & (c("debt_to_equity") <= g["dte_artifact_ceiling"]) & ~served
    rules = {
        "negative_fcf": (c("fcf") < 0) & ~F.coalesce(excused, F.lit(False)),
        "below_min_mktcap": c("market_cap") < g["min_market_cap"],
        "over_leveraged": F.when(F.coalesce(usable, F.lit(False)), c("net_debt_to_ebitda") > g["max_net_debt_to_ebitda"]).otherwise(by_equity),
        "heavy_insider_selling": c("insider_sentiment") < g["min_insider_sentiment"],
    }
    return _named({n: r & ~masked(b, MASKED_GATES, n) for n, r in rules.items()})


def flags(df: DataFrame, config: dict = CONFIG) -> Column:
    """Names of the soft advisories that hold; one without a block in the configuration is off."""
    c = lambda n: _input(df, n)
    fresh = lambda age, days: F.coalesce(c(age) <= days, F.lit(True))
    rules = {}

    def when(name: str, rule) -> None:
        block = config["flags"].get(name)
        if block is not None:
            rules[name] = rule(block)

    when("crowded_short", lambda x: (c("short_pct_outstanding") >= x["min_short"]) & (c("days_to_cover") >= x["min_days"]) & (c("short_interest_rising") > 0) & fresh("short_data_age_days", x["max_age"]))
    rules |= {n: c(n) > 0 for n in FILING_FLAGS if n in df.columns}
    when("insider_cluster_buy", lambda x: c("insider_distinct_buyers") >= x["min_distinct"])
    when("planned_sale", lambda x: c("insider_planned_sell_value") >= x["min_value"])
    when("dilution", lambda x: c("share_count_cagr") >= x["min_share_cagr"])
    when("cash_burn", lambda x: c("fcf") < 0)
    when("social_hype", lambda x: (c("social_mentions") >= x["min_mentions"]) & (c("social_rising") > 0) & F.coalesce(c("social_delta") >= x["min_delta"], F.lit(True)) & fresh("social_data_age_days", x["max_age"]))
    when("news_spike", lambda x: (c("news_count_7d") >= x["min_count"]) & (c("news_rising") > 0) & ~F.coalesce(c("news_truncated") > 0, F.lit(False)) & fresh("news_data_age_days", x["max_age"]))
    when("filing_text_change", lambda x: c("filing_text_similarity") < x["max_similarity"])
    return _named(rules)


def value_trap(df: DataFrame, config: dict = CONFIG) -> Column:
    """Cheap and weak; the share of won fundamental tests, where it is applicable and rests on enough of them, confirms or
    suppresses it, and suppression wins."""
    block = config["flags"].get("value_trap")
    if block is None:
        return F.lit(False)
    no = lambda x: F.coalesce(x, F.lit(False))
    base = no(F.col("quality") < block["max_quality"]) | no(F.col("growth") < block["max_growth"])
    fire = base
    if block["suppress_at"] is not None:
        enough = (_input(df, "piotroski_legs") >= block["min_legs"]) & ~masked(F.col("bucket"), MASKED_LEGS, "piotroski_f")
        share = F.when(enough, F.try_divide(_input(df, "piotroski_won"), _input(df, "piotroski_legs")))
        fire = F.when(share.isNull(), base).otherwise((base | (share <= block["confirm_at"])) & ~(share >= block["suppress_at"]))
    return no((F.col("value") >= block["min_value"]) & fire)


def risk_off(df: DataFrame, macro: Column, config: dict = CONFIG) -> Column:
    """A wary market and a name that is exposed to it: levered (an equity artefact does not count) or in a cyclical bucket."""
    block = config["flags"].get("risk_off_regime")
    if block is None:
        return F.lit(False)
    c, no = lambda n: _input(df, n), lambda x: F.coalesce(x, F.lit(False))
    levered = no(c("net_debt_to_ebitda") > block["max_net_debt_to_ebitda"]) | no((c("debt_to_equity") > F.greatest(F.lit(0.0), F.lit(float(block["max_debt_to_equity"])))) & (c("debt_to_equity") <= config["gates"]["dte_artifact_ceiling"]))
    cyclical = F.col("bucket").isin(list(block["cyclical_buckets"])) if block["cyclical_buckets"] else F.lit(False)
    return no(macro) & (levered | cyclical)


def score(metrics: DataFrame, config: dict = CONFIG, macro: Column | None = None) -> DataFrame:
    """Metrics (ticker, sic, any leg inputs) to cards: sub-scores, composite, confidence, scored, thin, gates, flags, abstentions
    (field, reason, scope) and abstained (the sub-scores among them). ``macro``: whether the market is wary."""
    df = prepared(metrics, config).withColumn("bucket", bucket(F.col("sic")))
    w, rule, names = config["weights"], config["validity"], legs(config)
    parts = {name: sub_score(df, name, config) for name in names}
    legs_out = [x for n in names if n not in ("insider", "risk") for x in names[n] if x in MASKED_LEGS]
    said = lambda field, reason, scope: F.struct(F.lit(field).alias("field"), reason.alias("reason"), F.lit(scope).alias("scope"))
    all_ = [F.when(masked(F.col("bucket"), MASKED_LEGS, x), said(x, F.lit("inapplicable"), "leg")) for x in legs_out]
    all_ += [F.when(why.isNotNull(), said(name, why, "subscore")) for name, (_, why) in parts.items() if name not in ("insider", "risk")]
    abstained = F.filter(F.array(*[F.when(why.isNotNull(), F.concat(F.lit(name + ":"), why)) for name, (_, why) in parts.items() if name != "risk"]), lambda x: x.isNotNull())
    cards = df.select("*", *[v.alias(name) for name, (v, _) in parts.items()], abstained.alias("abstained"), F.filter(F.array(*all_), lambda x: x.isNotNull()).alias("abstentions"), gates(df, config).alias("gates"), flags(df, config).alias("flags"))
    hidden = {name: F.array_contains("abstained", f"{name}:inapplicable") for name in COMPONENTS}
    total = sum((F.when(hidden[n], 0.0).otherwise(w[n]) for n in COMPONENTS), F.lit(0.0))
    there = sum((F.when(~hidden[n] & F.col(n).isNotNull(), w[n]).otherwise(0.0) for n in COMPONENTS), F.lit(0.0))
    composite = F.coalesce(weighted_present([(F.col(n), w[n]) for n in (*COMPONENTS, "risk") if n in w]), F.lit(0.0))
    cards = cards.withColumn("composite_raw", composite).withColumn("composite", F.bround(composite, 1)).withColumn("confidence", F.bround(F.when(total > 0, there / total).otherwise(0.0), 3))
    count = sum((F.when(F.col(n).isNotNull(), 1).otherwise(0) for n in COMPONENTS), F.lit(0))
    enough = F.when(F.col("bucket") == "unknown", F.lit(True)).otherwise(F.col("confidence") >= rule["min_scored_weight"])
    least = rule.get("min_composite_components")
    below = config["ranking"]["thin_below"]
    extra = F.array_compact(F.array(F.when(value_trap(df, config), F.lit("value_trap")), F.when(risk_off(df, macro if macro is not None else F.lit(False), config), F.lit("risk_off_regime"))))
    return cards.select(
        "*", (enough if least is None else enough & (count >= least)).alias("scored"), (F.col("confidence") < below if below is not None else F.lit(False)).alias("thin"),
        F.greatest("momentum", "value").alias("opportunity"), extra.alias("__extra")).withColumn("flags", F.concat("flags", "__extra")).drop("__extra")


def ranked(cards: DataFrame, top: int | None = None) -> DataFrame:
    """place: scored first, then composite, then confidence, ticker last; with ``top`` the first names without a gate
    (a top-k sort, not a global one)."""
    order = [F.desc("scored"), F.desc("composite"), F.desc("confidence"), F.asc("ticker")]
    if top is not None:
        return cards.where(F.size("gates") == 0).orderBy(*order).limit(top)
    return numbered(cards, order).withColumn("place", F.col("place").cast("int"))


def no_data(df: DataFrame) -> Column:
    """A card without any sub-score and without a market value says nothing about its name."""
    return F.coalesce(*[F.col(n) for n in COMPONENTS], _input(df, "market_cap")).isNull()


#: Stances from the most to the least hopeful, convictions from strong to weak, the best stance a gate allows.
STANCES = ["STRONG_BUY", "BUY", "HOLD", "AVOID", "STRONG_AVOID"]
CONVICTIONS = ["HIGH", "MEDIUM", "LOW"]
GATE_CEILINGS = {"negative_fcf": "AVOID", "over_leveraged": "AVOID"}
GATE_CEILING = "HOLD"
LOW_BELOW, MEDIUM_BELOW = 0.45, 0.70
CONTRA_FLAGS = ("value_trap",)


def corroborated(stance: Column, confidence: Column, flags_: Column, confirms: Column, contradicts: Column, red_flag: Column, medium_below: float = MEDIUM_BELOW, contra: tuple[str, ...] = CONTRA_FLAGS) -> Column:
    """Whether evidence backs a high conviction: a hopeful call needs a confirmation and no contrary flag, a wary one a
    contradiction or a red flag, a hold either; never at thin confidence."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    against = F.arrays_overlap(F.coalesce(flags_, F.array().cast("array<string>")), F.array(*map(F.lit, contra)))
    by_stance = F.when(stance.isin("STRONG_BUY", "BUY"), yes(confirms) & ~yes(against)).when(stance.isin("AVOID", "STRONG_AVOID"), yes(contradicts) | yes(red_flag)).otherwise(yes(confirms) | yes(contradicts))
    return yes(confidence >= medium_below) & by_stance


def clamp_call(stance: Column, conviction: Column, gates_: Column, confidence: Column, gaps: Column, backed: Column, ceilings: dict[str, str] = GATE_CEILINGS, ceiling: str = GATE_CEILING, low_below: float = LOW_BELOW, medium_below: float = MEDIUM_BELOW) -> Column:
    """Guarded call as a struct (stance, conviction, stance_clamped, conviction_capped, clamp_gates). A gate only moves the
    stance towards the wary end, and caps the conviction at medium if it does; thin confidence and gaps cap the conviction;
    a high one must be backed. An unknown stance counts as HOLD where stances are compared."""
    place = F.create_map(*[x for i, n in enumerate(STANCES) for x in (F.lit(n), F.lit(i))])
    limit = F.create_map(*[x for n, c in {**ceilings, "": ceiling}.items() for x in (F.lit(n), F.lit(STANCES.index(c)))])
    allowed = lambda g: F.coalesce(F.element_at(limit, g), F.lit(STANCES.index(ceiling)))
    tripped = F.coalesce(gates_, F.array().cast("array<string>"))
    now = F.coalesce(F.element_at(place, stance), F.lit(STANCES.index("HOLD")))
    top = F.array_max(F.transform(tripped, allowed))
    clamped = F.coalesce(top > now, F.lit(False))
    weak = F.coalesce(F.element_at(F.create_map(*[x for i, n in enumerate(CONVICTIONS) for x in (F.lit(n), F.lit(i))]), conviction), F.lit(2))
    least = F.when(clamped, 1).otherwise(0)
    thin = F.when(confidence.isNull() | (confidence < low_below), 2).when(confidence < medium_below, 1).otherwise(0)
    capped = F.greatest(weak, least, thin, F.when(F.size(F.coalesce(gaps, F.array().cast("array<string>"))) > 0, 1).otherwise(0))
    final = F.when((capped == 0) & ~F.coalesce(backed, F.lit(False)), 1).otherwise(capped)
    word = F.get(F.array(*map(F.lit, CONVICTIONS)), final)
    return F.struct(
        F.when(clamped, F.get(F.array(*map(F.lit, STANCES)), top)).otherwise(stance).alias("stance"), word.alias("conviction"), clamped.alias("stance_clamped"),
        (word != conviction).alias("conviction_capped"), F.when(clamped, F.filter(tripped, lambda g: allowed(g) == top)).alias("clamp_gates"))
