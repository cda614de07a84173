"""The seven conviction components of a long-term candidate. Branch order is the rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from norrsken.functions.numeric import fixed_text
from norrsken.functions.rules import first_match
from norrsken.functions.text import has_signal, public_risks, searchable
from norrsken.operators.quality import has_text, with_gate, with_thesis

COMPONENTS = (
    "Business quality", "Valuation", "Growth", "Balance sheet", "Momentum", "Risk",
    "Data confidence",
)
CONFIDENCE_METRICS = (
    "pe_ratio", "price_to_book", "ev_to_ebit", "revenue_eur_m", "book_value_eur_m",
    "net_income_eur_m", "net_cash_eur_m", "debt_to_equity", "revenue_growth_pct",
    "operating_margin_pct",
)


def _view(score: int, text: Column | str) -> Column:
    words = F.lit(text) if isinstance(text, str) else text
    return F.struct(F.lit(score).alias("score"), words.alias("view"))


def business_quality() -> Column:
    margin, profile = F.col("operating_margin_pct"), has_text(F.col("business_description"))
    return first_match(
        ((margin >= 15) & profile, _view(5, "Strong - profitable business with a clear profile.")),
        ((margin > 0) & profile, _view(4, "Good - profitable business with a clear profile.")),
        (margin > 0, _view(3, "Profitable, but the business profile is limited.")),
        (
            profile & margin.isNull(),
            _view(3, "Clear business profile, but margin data is missing."),
        ),
        (margin < 0, _view(1, "Weak - profitability is not yet proven.")),
        otherwise=_view(0, "Insufficient business and margin data."),
    )


def _any_multiple(test, pe: float, pb: float, ev: float) -> Column:
    pairs = (("pe_ratio", pe), ("price_to_book", pb), ("ev_to_ebit", ev))
    return F.greatest(*(F.coalesce(test(F.col(n), limit), F.lit(False)) for n, limit in pairs))


def valuation() -> Column:
    def at_most(metric: Column, limit: float) -> Column:
        return (metric > 0) & (metric <= limit)

    c = F.col
    summary = c("valuation.summary")
    direct = F.coalesce(
        c("valuation.primary_kind").isin("pe_ratio", "price_to_book", "ev_to_ebit"), F.lit(False)
    )
    return first_match(
        (
            _any_multiple(at_most, 12, 1.2, 10),
            _view(5, "Attractive valuation on available P/E or P/B metrics."),
        ),
        (
            c("valuation.is_attractive"),
            _view(5, F.concat(F.lit("Attractive valuation support: "), summary)),
        ),
        (
            _any_multiple(at_most, 20, 2.5, 16),
            _view(4, "Reasonable valuation on available multiples."),
        ),
        (
            c("valuation.has_support") & ~direct,
            _view(3, F.concat(F.lit("Valuation proxy available: "), summary)),
        ),
        (
            _any_multiple(lambda metric, limit: metric > limit, 35, 5, 25),
            _view(1, "Expensive on available valuation multiples."),
        ),
        (
            F.coalesce("pe_ratio", "price_to_book", "ev_to_ebit").isNotNull(),
            _view(2, "Valuation is available but not clearly attractive."),
        ),
        otherwise=_view(1, "No valuation multiple is available."),
    )


def growth() -> Column:
    rate = F.col("revenue_growth_pct")

    def words(before: str) -> Column:
        return F.concat(F.lit(before), fixed_text(F.abs(rate), 1), F.lit("%."))

    return first_match(
        (rate.isNull(), _view(1, "Revenue growth is not available.")),
        (rate >= 20, _view(5, words("Strong revenue growth of "))),
        (rate >= 5, _view(4, words("Healthy revenue growth of "))),
        (rate > 0, _view(3, words("Modest revenue growth of "))),
        otherwise=_view(1, words("Revenue declined ")),
    )


def balance_sheet() -> Column:
    cash, debt = F.col("net_cash_eur_m"), F.col("debt_to_equity")
    return first_match(
        ((cash > 0) & (debt <= 0.5), _view(5, "Net cash and conservative debt/equity.")),
        (
            (cash > 0) | (debt <= 0.5),
            _view(4, "Balance sheet looks conservative on available metrics."),
        ),
        (debt <= 1.5, _view(3, "Debt/equity looks manageable on available data.")),
        ((cash < 0) | (debt > 1.5), _view(1, "Leverage or net debt needs close review.")),
        otherwise=_view(1, "Balance sheet data is not available."),
    )


def momentum() -> Column:
    year, distance = F.col("one_year_return_pct"), F.col("distance_from_52w_high_pct")
    joined = F.col("all_signals")
    trading = (
        has_signal(joined, "intraday")
        | has_signal(joined, "live turnover")
        | has_signal(joined, "trading strategy")
        | has_signal(joined, "long-term strategy penalty")
    )
    return first_match(
        (trading, _view(1, "Intraday move is not enough for a long-term thesis.")),
        (
            (year <= -25) | (distance <= -30),
            _view(3, "Contrarian setup; verify why the market discounted it."),
        ),
        (
            (year >= 75) | (distance >= -5),
            _view(2, "Share price looks hot; do not let momentum drive the thesis."),
        ),
        (
            year.isNotNull() | distance.isNotNull(),
            _view(3, "Price context is available but secondary to fundamentals."),
        ),
        otherwise=_view(2, "No medium-term price context is available."),
    )


def risk() -> Column:
    shown, joined = F.col("shown_risks"), F.col("shown_risk_text")
    return first_match(
        (
            has_signal(joined, "extreme intraday spike") | has_signal(joined, "speculative low-price"),
            _view(1, "Speculative market signal; position sizing would matter."),
        ),
        (
            has_signal(joined, "negative operating margin") | has_signal(joined, "profitability"),
            _view(2, "Profitability risk needs manual confirmation."),
        ),
        (
            has_signal(joined, "low live turnover") | has_signal(joined, "thin liquidity"),
            _view(2, "Liquidity risk could make entry and exit difficult."),
        ),
        (F.size(shown) > 0, _view(3, F.array_join(F.slice(shown, 1, 2), "; "))),
        otherwise=_view(4, "No specific risk flag surfaced in the current screen."),
    )


def data_confidence() -> Column:
    profile = has_text(F.col("business_description"))
    known = sum((F.col(n).isNotNull().cast("int") for n in CONFIDENCE_METRICS), F.lit(0))
    return first_match(
        (
            (known == 0) & ~profile,
            _view(0, "No useful fundamentals or profile text are available today."),
        ),
        (
            (F.col("data_quality") == "good") & (known >= 4) & profile,
            _view(5, "Rich fundamentals and profile text are available."),
        ),
        (
            (known >= 4) & profile,
            _view(4, "Several fundamentals plus profile text are available."),
        ),
        (known >= 2, _view(3, "Some fundamentals are available; verify in reports.")),
        otherwise=_view(1, "Only limited fundamentals are available today."),
    )


def with_components(scored: DataFrame) -> DataFrame:
    """Adds ``components``, an array of (name, score, view) in fixed order."""
    df = scored if "gate" in scored.columns else with_gate(scored)
    # Texts that several branches search are columns of their own, built once per row.
    df = df.withColumns(
        {
            "all_signals": searchable(F.concat("catalysts", "risks", "reasons", "warnings")),
            "shown_risks": public_risks(F.concat("risks", "warnings")),
        }
    ).withColumn("shown_risk_text", F.lower(F.array_join("shown_risks", " ")))
    parts = zip(
        COMPONENTS,
        (
            business_quality(), valuation(), growth(), balance_sheet(), momentum(), risk(),
            data_confidence(),
        ),
        strict=True,
    )
    df = df.withColumns({f"component_{i}": part for i, (_, part) in enumerate(parts)})
    listed = F.array(
        *(
            F.struct(
                F.lit(name).alias("name"),
                F.col(f"component_{i}.score").alias("score"),
                F.col(f"component_{i}.view").alias("view"),
            )
            for i, name in enumerate(COMPONENTS)
        )
    )
    return df.withColumn("components", listed).drop(
        "all_signals", "shown_risks", "shown_risk_text",
        *(f"component_{i}" for i in range(len(COMPONENTS))),
    )


def with_conviction(scored: DataFrame) -> DataFrame:
    """Adds the record published for long-term candidates: bucket, thesis, components."""
    df = with_thesis(with_components(scored))
    by_name = F.map_from_entries(
        F.transform(
            "components",
            lambda x: F.struct(x["name"], F.struct(x["score"].alias("score"), x["view"].alias("view"))),
        )
    )
    return df.withColumn(
        "conviction", F.struct("bucket", "thesis", by_name.alias("components"))
    ).drop("components")
