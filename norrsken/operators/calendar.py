"""Trading calendar of the two markets as a DataFrame, and market names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from norrsken import constants as K
from norrsken.functions.dates import easter_sunday

MARKETS = ("stockholm", "helsinki")


def normalise_market(raw: Column) -> Column:
    """Alias to market name; unknown names are null."""
    known = F.create_map(*(F.lit(p) for pair in K.MARKET_ALIASES.items() for p in pair))
    return F.try_element_at(known, F.lower(F.trim(raw)))


def market_names(raw: Sequence[str]) -> list[str]:
    """The driver-side form for arguments: unknown names raise."""
    unknown = [name for name in raw if name.strip().lower() not in K.MARKET_ALIASES]
    if unknown:
        raise ValueError(f"unsupported market {unknown[0]!r}; supported markets: helsinki, stockholm")
    return sorted({K.MARKET_ALIASES[name.strip().lower()] for name in raw})


def closed_reason(day: Column, market: Column) -> Column:
    """Why a market is closed on a day, null when it is open."""
    year = F.year(day)
    easter = easter_sunday(year)
    month_day = F.month(day) * 100 + F.dayofmonth(day)
    # Of two reasons for one day the earlier branch counts, as when Ascension Day falls on May Day.
    return (
        F.when(F.weekday(day) >= 5, "Weekend")
        .when((month_day == 606) & (market == "stockholm"), "Swedish National Day")
        .when((month_day == 1206) & (market == "helsinki"), "Finnish Independence Day")
        .when(month_day == 1231, "New Year's Eve")
        .when(month_day == 1226, "Boxing Day")
        .when(month_day == 1225, "Christmas Day")
        .when(month_day == 1224, "Christmas Eve")
        .when(month_day.between(619, 625) & (F.weekday(day) == 4), "Midsummer Eve")
        .when(day == F.date_add(easter, 39), "Ascension Day")
        .when(month_day == 501, "May Day")
        .when(day == F.date_add(easter, 1), "Easter Monday")
        .when(day == F.date_sub(easter, 2), "Good Friday")
        .when(month_day == 106, "Epiphany")
        .when(month_day == 101, "New Year's Day")
    )


def market_calendar(days: DataFrame, markets: Sequence[str] = MARKETS) -> DataFrame:
    """One row per day and market. ``days`` has a ``day`` column."""
    names = F.explode(F.array(*(F.lit(m) for m in market_names(markets))))
    return (
        days.select("day", names.alias("market"))
        .withColumn("reason", closed_reason(F.col("day"), F.col("market")))
        .withColumn("is_open", F.col("reason").isNull())
    )


def markets_open(calendar: DataFrame) -> DataFrame:
    """Days on which all markets of the calendar are open."""
    return calendar.groupBy("day").agg(F.bool_and("is_open").alias("all_open"))


def day_spine(bounds: DataFrame, first: str, last: str) -> DataFrame:
    """All days from the least ``first`` to the greatest ``last`` of a frame."""
    ends = bounds.agg(F.min(first).cast("date").alias("a"), F.max(last).cast("date").alias("b"))
    return ends.where("a is not null").select(
        F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day")
    )
