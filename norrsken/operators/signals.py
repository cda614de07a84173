"""Market fields to catalysts and risks, and the classes of signal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from norrsken import constants as K
from norrsken.functions.numeric import compact_number
from norrsken.functions.rules import Rule, fired_texts
from norrsken.functions.text import has_signal, searchable


def live_catalysts(price: Column, change: Column, turnover: Column) -> Column:
    label = F.when(change >= 10.0, K.STRONG_MOMENTUM).otherwise(K.POSITIVE_MOMENTUM)
    moved = F.concat(label, F.lit(" (+"), compact_number(change), F.lit("%)"))
    return fired_texts(
        [
            Rule(price.isNotNull(), text=K.LIVE_PRICE),
            Rule(change >= 5.0, text=moved),
            Rule(turnover >= 1_000_000, text=K.HIGH_TURNOVER),
            Rule((turnover >= 250_000) & (turnover < 1_000_000), text=K.MODERATE_TURNOVER),
        ]
    )


def live_risks(
    has_quote: Column, price: Column, change: Column, turnover: Column, volume: Column
) -> Column:
    return fired_texts(
        [
            Rule(F.lit(True), text=K.SPARSE_DATA),
            Rule(change >= 40.0, text=K.EXTREME_SPIKE),
            Rule(change <= -5.0, text=K.SHARP_SELLOFF),
            Rule((price > 0) & (price < 1.0), text=K.LOW_PRICE),
            Rule(turnover < 100_000, text=K.LOW_TURNOVER),
            Rule(has_quote & turnover.isNull() & volume.isNull(), text=K.MISSING_TURNOVER),
        ]
    )


def with_live_signals(listing: DataFrame, quote: DataFrame) -> DataFrame:
    """Listing left-joined with its quote on (ticker, country), plus catalysts and risks.

    A listing without quote keeps only the sparse-data risk.
    """
    quotes = quote.select(
        "ticker", "country", "price", "price_currency", "percentage_change", "turnover",
        "volume", F.lit(True).alias("has_quote"),
    )
    c = F.col
    return (
        listing.join(quotes, ["ticker", "country"], "left")
        .withColumn("has_quote", F.coalesce(c("has_quote"), F.lit(False)))
        .withColumns(
            {
                "catalysts": live_catalysts(c("price"), c("percentage_change"), c("turnover")),
                "risks": live_risks(
                    c("has_quote"), c("price"), c("percentage_change"), c("turnover"), c("volume")
                ),
            }
        )
    )


# Classes of one signal text --------------------------------------------------------------------


def is_intraday(signal: Column) -> Column:
    return F.lower(signal).contains("intraday momentum")


def is_trading_only(signal: Column) -> Column:
    return is_intraday(signal) | signal.isin(*K.TRADING_ONLY_SIGNALS)


def is_material_event(signal: Column) -> Column:
    """Substring match, so "win" also finds "window"."""
    return ~is_trading_only(signal) & F.lower(signal).rlike("|".join(K.EVENT_TERMS))


def is_trading_relevant(signal: Column) -> Column:
    return (
        is_intraday(signal)
        | signal.isin(K.HIGH_TURNOVER, K.MODERATE_TURNOVER)
        | is_material_event(signal)
    )


def has_trading_setup(catalysts: Column) -> Column:
    joined = searchable(catalysts)
    high, moderate = has_signal(joined, K.HIGH_TURNOVER), has_signal(joined, K.MODERATE_TURNOVER)
    return (
        high
        | has_signal(joined, K.STRONG_MOMENTUM)
        | (has_signal(joined, K.POSITIVE_MOMENTUM) & moderate)
        | F.exists(catalysts, is_material_event)
    )
