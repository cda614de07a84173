"""Long-term quality: valuation support, proof gaps, bucket, thesis, gate tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from norrsken import constants as K
from norrsken.functions.numeric import compact_number, round_dp
from norrsken.functions.rules import Rule, fired_texts, first_match, total_points
from norrsken.functions.text import has_signal, searchable, strip
from norrsken.schemas import null_of


# --- fixed values: valuation kinds in the order of preference: limit, summary ----------------
DIRECT_MULTIPLES = {
    "pe_ratio": (14.0, "P/E is ", "."),
    "price_to_book": (1.5, "Price/book is ", "."),
    "ev_to_ebit": (12.0, "EV/EBIT is ", "."),
}
PROXIES = {
    "market_cap_to_sales": ("revenue_eur_m", 2.0, "Market cap/sales is ", "x."),
    "market_cap_to_book": ("book_value_eur_m", 1.5, "Market cap/book value is ", "x."),
    "net_cash_to_market_cap": ("net_cash_eur_m", 20.0, "Net cash equals ", "% of market cap."),
    "earnings_yield_pe": ("net_income_eur_m", 14.0, "Implied P/E is ", "."),
}
SHARE_OF_CAP = "net_cash_to_market_cap"
NO_VALUATION = "No valuation metric or proxy is available."


def with_valuation(research: DataFrame) -> DataFrame:
    """Adds the valuation struct.

    The first positive direct multiple decides, even if a later one is cheaper. Without one, the
    first computable proxy over a positive market cap decides. Kind, value and wording are built
    in steps, so that the number text is generated once and not once per kind.
    """
    c = F.col
    kind, value = c("valuation_kind"), c("valuation_value")
    cap = c("market_cap_eur_m")
    named = [(c(name) > 0, F.lit(name)) for name in DIRECT_MULTIPLES]
    named += [((cap > 0) & (c(base) > 0), F.lit(name)) for name, (base, *_) in PROXIES.items()]
    computed = F.coalesce(
        *(F.when(kind == name, c(name)) for name in DIRECT_MULTIPLES),
        *(
            F.when(kind == name, c(base) / cap * 100.0 if name == SHARE_OF_CAP else cap / c(base))
            for name, (base, *_) in PROXIES.items()
        ),
    )
    rounded = c("valuation_rounded")
    # Proxies are judged and worded after rounding, direct multiples before.
    shown = F.when(kind.isin(*DIRECT_MULTIPLES), value).otherwise(rounded)
    wording = {name: (a, b) for name, (_, a, b) in DIRECT_MULTIPLES.items()}
    wording |= {name: (a, b) for name, (_, _, a, b) in PROXIES.items()}
    before = F.coalesce(*(F.when(kind == n, a) for n, (a, _) in wording.items()))
    after = F.coalesce(*(F.when(kind == n, b) for n, (_, b) in wording.items()))
    limits = {name: limit for name, (limit, *_) in DIRECT_MULTIPLES.items()}
    limits |= {name: limit for name, (_, limit, *_) in PROXIES.items()}
    limit = F.coalesce(*(F.when(kind == n, F.lit(x)) for n, x in limits.items()))
    cheap = F.when(kind == SHARE_OF_CAP, c("valuation_shown") >= limit).otherwise(
        c("valuation_shown") <= limit
    )
    summary = F.concat(before, compact_number(c("valuation_shown")), after)
    return (
        research.withColumn("valuation_kind", first_match(*named, otherwise=null_of("string")))
        .withColumn("valuation_value", computed)
        .withColumn("valuation_rounded", round_dp(value, 2))
        .withColumn("valuation_shown", shown)
        .withColumn(
            "valuation",
            F.struct(
                kind.isNotNull().alias("has_support"),
                F.coalesce(cheap, F.lit(False)).alias("is_attractive"),
                kind.alias("primary_kind"),
                rounded.alias("primary_value"),
                F.coalesce(summary, F.lit(NO_VALUATION)).alias("summary"),
            ),
        )
        .drop("valuation_kind", "valuation_value", "valuation_rounded", "valuation_shown")
    )


def has_text(column: Column) -> Column:
    return F.coalesce(column != "", F.lit(False))


def _quality_rules() -> list[Rule]:
    c = F.col
    margin, growth = c("operating_margin_pct"), c("revenue_growth_pct")
    return [
        Rule(c("segment") == "first_north", 5.0, "First North discovery opportunity"),
        Rule(margin > 0, 10.0, "Positive operating margin"),
        Rule(growth > 0, 8.0, "Revenue growth"),
        Rule(c("net_cash_eur_m") > 0, 7.0, "Net cash balance sheet"),
        Rule(c("debt_to_equity") <= 0.5, 5.0, "Conservative balance sheet"),
        Rule(c("valuation.is_attractive"), 8.0, "Attractive valuation support"),
        Rule(
            c("valuation.has_support") & ~c("valuation.is_attractive"),
            2.0, "Valuation data available",
        ),
        Rule(has_text(c("business_description")), 4.0, "Business description available"),
        Rule(c("average_daily_value_eur") >= 100_000, 3.0, "Adequate liquidity"),
    ]


def durable_support() -> Column:
    c = F.col
    tests = (
        c("operating_margin_pct") > 0, c("revenue_growth_pct") > 0, c("net_cash_eur_m") > 0,
        c("debt_to_equity") <= 0.5, c("valuation.is_attractive"),
        c("business_description") != "",
    )
    return F.greatest(*(F.coalesce(t, F.lit(False)) for t in tests))


def live_only_terms(catalysts: Column) -> Column:
    joined = searchable(catalysts)
    return (
        has_signal(joined, "live price available")
        | has_signal(joined, "live turnover")
        | has_signal(joined, "intraday momentum")
    )


def _gap_rules() -> list[Rule]:
    c = F.col
    margin, growth, daily = (
        c("operating_margin_pct"), c("revenue_growth_pct"), c("average_daily_value_eur")
    )
    return [
        Rule(margin < 0, 14.0, "Negative operating margin"),
        Rule(margin.isNull() | (margin == 0), 8.0, "No profitability signal"),
        Rule(growth.isNull() | (growth <= 0), 7.0, "No growth signal"),
        Rule(c("debt_to_equity") > 1.5, 10.0, "High debt/equity"),
        Rule(~c("valuation.has_support"), 9.0, "Missing valuation data"),
        Rule(~has_text(c("business_description")), 5.0, "Missing business description"),
        Rule(daily < 100_000, 7.0, "Thin liquidity"),
        Rule(daily.isNull(), 6.0, "Missing liquidity data"),
        Rule(c("live_only"), 12.0, "Only live-market support"),
        Rule(c("data_quality") == "thin", 8.0, "Thin data quality"),
    ]


def _bucket() -> Column:
    c = F.col
    added, lost = c("quality_adjustment"), c("proof_penalty")
    return first_match(
        ((lost >= 35) | (F.size("proof_gaps") >= 5), F.lit(K.BUCKET_INSUFFICIENT)),
        ((added >= 32) & (lost <= 8), F.lit(K.BUCKET_QUALITY)),
        ((added >= 20) & (lost <= 18), F.lit(K.BUCKET_WATCHLIST)),
        otherwise=F.lit(K.BUCKET_SPECULATIVE),
    )


def _thesis() -> Column:
    """Fixed sentences by bucket; the speculative one names the first gap."""
    c = F.col
    name = c("name")
    issue = F.coalesce(F.lower(F.get(c("proof_gaps"), 0)), F.lit("the evidence is incomplete"))
    sentences = {
        K.BUCKET_QUALITY: F.concat(
            name, F.lit(
                " has multiple long-term quality signals for a small-cap research queue; verify "
                "valuation, reporting cadence, and liquidity before acting."
            ),
        ),
        K.BUCKET_WATCHLIST: F.concat(
            name, F.lit(
                " has enough fundamental evidence for manual research, but at least one proof gap "
                "should be checked before it becomes a high-priority idea."
            ),
        ),
        K.BUCKET_SPECULATIVE: F.concat(
            name, F.lit(
                " is an interesting small-cap monitor, but the long-term case needs more proof "
                "because "
            ),
            issue, F.lit("."),
        ),
        K.BUCKET_INSUFFICIENT: F.concat(
            name, F.lit(
                " lacks enough durable evidence for a strong long-term thesis today; wait for "
                "clearer fundamentals, valuation, liquidity, or business evidence."
            ),
        ),
    }
    return F.coalesce(*(F.when(c("bucket") == k, text) for k, text in sentences.items()))


def with_quality(research: DataFrame) -> DataFrame:
    """Adds valuation, quality_adjustment, proof_penalty, quality_reasons, proof_gaps, bucket."""
    added, gaps = _quality_rules(), _gap_rules()
    df = with_valuation(research) if "valuation" not in research.columns else research
    live_only = live_only_terms(F.col("catalysts")) & ~durable_support()
    df = df.withColumn("live_only", live_only).withColumns(
        {
            "quality_adjustment": total_points(added),
            "quality_reasons": fired_texts(added),
            "proof_gaps": fired_texts(gaps),
            "gap_points": total_points(gaps),
        }
    )
    # Partial data costs points only together with a gap, and leaves no text.
    partial = F.when((F.col("data_quality") == "partial") & (F.size("proof_gaps") > 0), 3.0)
    df = df.withColumn("proof_penalty", F.col("gap_points") + F.coalesce(partial, F.lit(0.0)))
    return df.drop("gap_points", "live_only").withColumn("bucket", _bucket())


def with_thesis(df: DataFrame) -> DataFrame:
    return df.withColumn("thesis", _thesis())


def durable_anchors() -> Column:
    c = F.col
    return fired_texts(
        [
            Rule(c("operating_margin_pct") > 0, text="positive operating margin"),
            Rule(c("revenue_growth_pct") > 0, text="revenue growth"),
            Rule(c("net_cash_eur_m") > 0, text="net cash balance sheet"),
            Rule(c("debt_to_equity") <= 0.5, text="conservative balance sheet"),
            Rule(c("average_daily_value_eur") >= 100_000, text="adequate liquidity"),
            Rule(c("valuation.is_attractive"), text="attractive valuation support"),
            Rule(
                c("valuation.has_support") & ~c("valuation.is_attractive"),
                text="valuation data available",
            ),
        ]
    )


def with_gate(df: DataFrame) -> DataFrame:
    """Adds the gate struct; needs ``with_quality`` first."""
    c = F.col
    if "bucket" not in df.columns:
        df = with_quality(df)
    severe = F.array(*(F.lit(gap) for gap in K.SEVERE_GAPS))
    df = df.withColumns(
        {"anchors": durable_anchors(), "severe_gaps": F.array_intersect("proof_gaps", severe)}
    )
    anchors, has_support = F.size("anchors"), c("valuation.has_support")
    blocked = (F.size("severe_gaps") > 0) | (anchors < 2) | ~has_support
    promoted = (c("bucket") == K.BUCKET_QUALITY) | (
        (c("bucket") == K.BUCKET_WATCHLIST) & (anchors >= 3)
    )
    tier = first_match(
        (promoted & ~blocked, F.lit(K.TIER_HIGH)),
        (c("bucket").isin(K.BUCKET_QUALITY, K.BUCKET_WATCHLIST), F.lit(K.TIER_WATCHLIST)),
        (c("bucket") == K.BUCKET_SPECULATIVE, F.lit(K.TIER_SPECULATIVE)),
        otherwise=F.lit(K.TIER_INSUFFICIENT),
    )
    none = F.array().cast("array<string>")
    support = F.when(has_support, F.array(F.lit("valuation support available"))).otherwise(none)
    missing = F.when(has_support, none).otherwise(F.array(F.lit("missing valuation support")))
    gate = F.struct(
        tier.alias("tier"),
        F.array_distinct(F.concat("anchors", support)).alias("reasons"),
        F.array_distinct(
            F.concat(F.transform("severe_gaps", lambda g: F.lower(strip(g))), missing)
        ).alias("blockers"),
        anchors.alias("durable_anchor_count"),
        F.size("severe_gaps").alias("severe_proof_gap_count"),
        c("valuation").alias("valuation"),
    )
    return df.withColumn("gate", gate).drop("anchors", "severe_gaps")


def tier_order(tier: Column) -> Column:
    order = F.lit(len(K.TIERS))
    for position, name in enumerate(K.TIERS):
        order = F.when(tier == name, position).otherwise(order)
    return order


def tier_counts(gated: DataFrame, *by: str) -> DataFrame:
    """Rows per tier, all tiers present, and whether no row reached the highest tier."""
    counted = gated.groupBy(*by, F.col("gate.tier").alias("tier")).agg(F.count("*").alias("n"))
    tallies = counted.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("tier", "n"))).alias("tallies")
    )
    # At most four entries per group reach the list: one per tier.
    tiers = F.explode(F.array(*(F.lit(t) for t in K.TIERS)))
    return tallies.select(*by, "tallies", tiers.alias("tier")).select(
        *by,
        "tier",
        tier_order(F.col("tier")).alias("tier_order"),
        F.coalesce(F.try_element_at("tallies", F.col("tier")), F.lit(0)).cast("long").alias("companies"),
        F.try_element_at("tallies", F.lit(K.TIER_HIGH)).isNull().alias("no_high_conviction"),
    )
