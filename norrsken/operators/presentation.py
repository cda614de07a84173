"""Sentences about a company: presentation, valuation view, profile texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from norrsken.functions.numeric import compact_number, fixed_text
from norrsken.functions.text import texts


def with_presentation(df: DataFrame, name: str = "company_presentation") -> DataFrame:
    """Adds one sentence on the listing and a second with up to four facts."""
    c = F.col
    country = (
        F.when(F.upper("country") == "SE", "Sweden")
        .when(F.upper("country") == "FI", "Finland")
        .otherwise(F.upper("country"))
    )
    segment = (
        F.when(c("segment") == "first_north", "First North")
        .when(c("segment") == "main_market", "main market")
        .when(c("segment") == "spotlight", "Spotlight")
        .otherwise("public market")
    )
    kind = F.concat_ws(" ", segment, F.when(c("sector") != "", c("sector")))
    base = F.concat(
        c("name"), F.lit(" is a "), country, F.lit("-listed "), kind, F.lit(" company on "),
        c("exchange"), F.lit("."),
    )
    cap = c("market_cap_eur_m")
    cap_text = F.when(F.abs(cap) >= 100, fixed_text(cap, 0)).otherwise(fixed_text(cap, 1))

    def share(label: str, column: str) -> Column:
        return F.concat(F.lit(f"{label} is "), fixed_text(c(column), 1), F.lit("%"))

    facts = texts(
        F.concat(F.lit("Market cap is about EUR "), cap_text, F.lit("m")),
        share("revenue growth", "revenue_growth_pct"),
        share("operating margin", "operating_margin_pct"),
        share("one-year return", "one_year_return_pct"),
    )
    n = F.size("facts")
    listed = (
        F.when(n <= 2, F.array_join("facts", " and "))
        .otherwise(
            F.concat(
                F.array_join(F.slice("facts", 1, F.greatest(n - 1, F.lit(0))), ", "),
                F.lit(", and "), F.get("facts", n - 1),
            )
        )
    )
    sentence = F.concat_ws(" ", base, F.when(n > 0, F.concat(listed, F.lit("."))))
    return df.withColumn("facts", facts).withColumn(name, sentence).drop("facts")


def business_summary() -> Column:
    c = F.col
    sector = F.coalesce(F.when(c("sector") != "", c("sector")), F.lit("unknown sector"))
    return F.concat(
        c("name"), F.lit(" is a "), c("country"), F.lit("-listed "), sector,
        F.lit(" company on "), c("exchange"), F.lit("."),
    )


def valuation_view() -> Column:
    """Price (worded by its source), P/E, price/book, net cash or debt."""
    c = F.col
    from_market = F.exists("evidence", lambda e: F.coalesce(e["source"] == "nasdaq", F.lit(False)))
    amount = F.concat(compact_number(c("price")), F.lit(" "), c("price_currency"))
    price = F.when(
        c("price").isNotNull() & (c("price_currency") != ""),
        F.when(
            from_market, F.concat(F.lit("Live price is "), amount, F.lit(" from Nasdaq Nordic."))
        ).otherwise(F.concat(F.lit("Price is "), amount, F.lit("."))),
    )

    def metric(label: str, value: Column, known: Column) -> Column:
        missing = F.lit(f"{label} is unavailable in the current dataset.")
        return F.when(
            known, F.concat(F.lit(f"{label} is "), compact_number(value), F.lit("."))
        ).otherwise(missing)

    cash = c("net_cash_eur_m")
    holding = F.concat(
        F.when(cash >= 0, "Net cash is EUR ").otherwise("Net debt is EUR "),
        compact_number(F.abs(cash)), F.lit("m."),
    )
    return texts(
        price,
        metric("P/E", c("pe_ratio"), c("pe_ratio") > 0),
        metric("Price/book", c("price_to_book"), c("price_to_book").isNotNull()),
        F.coalesce(holding, F.lit("Net cash or net debt is unavailable in the current dataset.")),
    )


# --- fixed values: profile texts ------------------------------------------------------------
NO_REASON = "Scoring did not surface a specific reason; manual triage is needed."
NO_CATALYST = "No explicit catalyst is available in the current research fixture."
NO_RISK = "No explicit risk is available in the current research fixture."
BASE_CASE = (
    "The evidence is triage-level only, so this is a watchlist candidate rather than an "
    "investment conclusion."
)
MANUAL_CHECKS = (
    "Review the latest annual and interim reports.",
    "Check company announcements plus insider and ownership disclosures.",
    "Verify liquidity, trading volume, and bid/ask spread.",
    "Compare valuation against Nordic peers.",
)


def or_default(items: str, default: str) -> Column:
    return F.when(F.size(items) > 0, F.col(items)).otherwise(F.array(F.lit(default)))
