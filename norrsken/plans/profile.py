"""Company profiles for a set of tickers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from norrsken.functions.text import clean_key
from norrsken.operators.presentation import (
    BASE_CASE,
    MANUAL_CHECKS,
    NO_CATALYST,
    NO_REASON,
    NO_RISK,
    business_summary,
    or_default,
    valuation_view,
    with_presentation,
)
from norrsken.operators.ranking import top_k
from norrsken.operators.scoring import with_base_score


def first_by_ticker(research: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """The first listing in load order per ticker, for the wanted tickers or for all."""
    if tickers is not None:
        wanted = tickers.select(clean_key(F.col("ticker")).alias("ticker")).distinct()
        research = research.join(wanted, "ticker", "left_semi")
    return top_k(research, 1, ["ticker"], [F.col("ordinal").asc()]).drop("rank")


def missing_tickers(research: DataFrame, tickers: DataFrame) -> DataFrame:
    """Wanted tickers without any listing; callers treat a row here as an error."""
    wanted = tickers.select(clean_key(F.col("ticker")).alias("ticker")).distinct()
    return wanted.join(research.select("ticker"), "ticker", "left_anti")


def company_profiles(research: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Research, base score and the profile sentences."""
    scored = with_base_score(first_by_ticker(research, tickers))
    return with_presentation(scored, "presentation").withColumns(
        {
            "business_summary": business_summary(),
            "valuation_view": valuation_view(),
            "why_it_appeared": or_default("reasons", NO_REASON),
            "bull_case": or_default("catalysts", NO_CATALYST),
            "base_case": F.array(F.lit(BASE_CASE)),
            "bear_case": or_default("risks", NO_RISK),
            "next_manual_checks": F.array(*(F.lit(t) for t in MANUAL_CHECKS)),
        }
    )
