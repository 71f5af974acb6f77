"""A merged snapshot to the flat row that the screen reads: supplied values first, computed ones where they are missing, trends and ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions.columns import age_days, ratio

#: Days to cover at which a feed means "none", and the largest share of stock sold short that is believed.
NO_COVER, MOST_SHORT = 999.99, 0.60
TAX = 0.21


def _c(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def _growth(now: Column, before: Column) -> Column:
    return F.when(before > 0, F.try_divide(now - before, before))


def flat_metrics(snapshots: DataFrame) -> DataFrame:
    """Snapshots (ticker, as_of and any section fields, one row each) with the derived fields of the screen.

    A supplied ratio always wins; otherwise it is computed from the statements' newest year (suffix 0: revenue0, fcf0, ...), whose
    yearly returns on capital come as an array (roic_by_year, newest first). Leverage needs positive EBITDA, interest counts by its
    size. Trends compare a value with the one before it and are NULL where that is not reliable; ages are whole days from
    the day of the data to the day of the snapshot. One projection, no shuffle."""
    c = lambda n: _c(snapshots, n)
    have = snapshots.columns
    years = F.col("roic_by_year") if "roic_by_year" in have else F.array().cast("array<double>")
    mean = F.try_divide(F.aggregate(years, F.lit(0.0), lambda a, x: a + x), F.size(years))
    cash, ebitda = F.coalesce(c("cash_and_equivalents"), c("cash0")), F.coalesce(c("ebitda"), c("ebitda0"))
    debt, cap, price = c("total_debt0"), c("market_cap"), c("price")
    net_debt = F.when(debt.isNotNull() & cash.isNotNull(), debt - cash)
    ev = cap + net_debt
    legs = [c(n) for n in ("dividends_paid", "repurchases", "debt_repayments", "debt_issuance")]
    size = lambda x: F.coalesce(F.abs(x), F.lit(0.0))
    paid = F.when(F.coalesce(*legs).isNotNull() & (cap > 0), F.try_divide(size(legs[0]) + size(legs[1]) + size(legs[2]) - size(legs[3]), cap))
    shares = ratio(cap, price)
    short = F.when(shares != 0, F.try_divide(c("short_shares"), shares))
    surprises = F.col("surprises") if "surprises" in have else F.array().cast("array<double>")
    n = F.size(F.coalesce(surprises, F.array().cast("array<double>")))
    average = F.try_divide(F.aggregate(surprises, F.lit(0.0), lambda a, x: a + x), n)
    spread = F.sqrt(F.try_divide(F.aggregate(surprises, F.lit(0.0), lambda a, x: a + F.pow(x - average, F.lit(2.0))), n))
    day = lambda name: F.to_date(_c(snapshots, name)) if name in have else F.lit(None).cast("date")
    said = day("last_report_day")
    filed = F.when(F.coalesce(c("last_report_estimated").cast("boolean"), F.lit(False)), day("last_report_filed"))
    pe = F.coalesce(c("pe_ttm"), F.when(price != 0, ratio(price, c("diluted_eps0"))))
    age = lambda d: age_days(F.col("as_of"), d)
    derived = {
        "roic": F.coalesce(c("roic"), F.get(years, F.lit(0))),
        "roic_5y_avg": F.coalesce(c("roic_5y_avg"), F.when(c("roic").isNull() & (F.size(years) >= 2), mean)),
        "revenue": F.coalesce(c("revenue"), c("revenue0")), "cash_and_equivalents": cash, "ebitda": ebitda,
        "interest_coverage": F.coalesce(c("interest_coverage"), ratio(c("operating_income0"), F.abs(c("interest_expense0")))),
        "net_debt_to_ebitda": F.coalesce(c("net_debt_to_ebitda"), F.when(ebitda > 0, F.try_divide(net_debt, ebitda))),
        "ebit_ev_yield": F.coalesce(c("ebit_ev_yield"), F.when((c("operating_income0") > 0) & (ev > 0), F.try_divide(c("operating_income0"), ev))),
        "shareholder_yield": F.coalesce(c("shareholder_yield"), paid), "fcf_yield": F.coalesce(c("fcf_yield"), ratio(c("fcf0"), cap)), "fcf_positive": c("fcf0") > 0,
        "pe_ttm": pe,
        "price_vs_200dma": F.coalesce(c("price_vs_200dma"), ratio(price, c("sma_200")) - 1), "upside_to_target": F.when((c("target_median") != 0) & (price != 0), F.try_divide(c("target_median"), price) - 1), "pe_vs_history": F.when((pe > 0) & (c("pe_median") != 0), F.try_divide(c("pe_median"), pe) - 1),
        "days_to_cover": F.when(c("days_to_cover") < NO_COVER, c("days_to_cover")), "short_pct_outstanding": F.when(short.between(0.0, MOST_SHORT), short),
        "short_interest_rising": F.when(~F.coalesce(c("split_flag").cast("boolean"), F.lit(False)), c("short_shares") > c("prev_short_shares")), "short_data_age_days": age(day("settlement_day")),
        "social_rising": c("social_mentions") > c("mentions_day_ago"), "social_delta": F.when(c("mentions_day_ago") != 0, F.try_divide(c("social_mentions") - c("mentions_day_ago"), c("mentions_day_ago"))), "social_data_age_days": age(day("social_day")),
        "news_rising": c("news_count_7d") > c("news_count_prior"), "news_data_age_days": age(day("news_day")),
        "contract_growth": _growth(c("contract_ttm"), c("contract_prior")), "contract_to_revenue": ratio(c("contract_ttm"), F.coalesce(c("revenue"), c("revenue0"))), "contract_age_days": age(F.coalesce(day("contract_day"), day("contract_asked"))),
        "lobbying_growth": F.when(c("lobbying_prior") != 0, F.try_divide(c("lobbying_ttm") - c("lobbying_prior"), c("lobbying_prior"))), "lobbying_age_days": age(F.coalesce(day("lobbying_day"), day("lobbying_asked"))),
        "beat_rate": F.when(c("quarters") > 0, F.try_divide(c("beats"), c("quarters"))), "average_surprise": F.when(n > 0, average), "surprise_dispersion": F.when(n >= 3, spread), "last_surprise": F.get(surprises, F.lit(0)), "earnings_quarters": F.when(c("quarters") > 0, c("quarters")),
        "days_to_report": -age(day("next_report_day")), "days_since_report": age(F.greatest(said, filed)),
    }
    return snapshots.select(*[x for x in have if x not in derived], *[v.alias(k) for k, v in derived.items()])
