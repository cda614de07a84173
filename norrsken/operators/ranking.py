"""Filters, company dedupe, top-k ranks and country quotas.

Every ``row_number() <= k`` filter below sits directly on its window, so Spark cuts each map
task's rows to k per group before the shuffle. A company name, country or strategy that holds a
third of all rows therefore sends k rows per task, not a third of the table, to one task. Spark does so for k up
to its ``windowGroupLimitThreshold``. Longer lists are selected by counting: rows per score give the score of
the k-th row, and only rows that reach it are sorted, by ranges that many tasks share.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from norrsken.functions.text import company_key, strip
from norrsken.operators.quality import tier_order
from norrsken.session import checkpointed

def most_window_rows(df: DataFrame) -> int:
    """Longest list that Spark limits before the shuffle, by the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))


def company_filter(
    listing: DataFrame,
    countries: Sequence[str] | None = None,
    include_first_north: bool = True,
    min_market_cap: float | None = None,
    max_market_cap: float | None = None,
    sector: str | None = None,
) -> DataFrame:
    """Country, segment, market cap and sector. An unknown cap fails when a bound is set."""
    if countries is not None:
        listing = listing.where(F.col("country").isin(*(c.upper() for c in countries)))
    if not include_first_north:
        listing = listing.where(F.coalesce(F.col("segment"), F.lit("")) != "first_north")
    if min_market_cap is not None:
        listing = listing.where(F.col("market_cap_eur_m") >= min_market_cap)
    if max_market_cap is not None:
        listing = listing.where(F.col("market_cap_eur_m") <= max_market_cap)
    if sector is not None:
        known = F.lower(strip(F.coalesce(F.col("sector"), F.lit(""))))
        listing = listing.where(known == sector.strip().lower())
    return listing


def score_order() -> list[Column]:
    """Best score first, then ticker, then load order (sorts are stable in load order)."""
    return [F.col("total").desc(), F.col("ticker").asc(), F.col("ordinal").asc()]


def tier_score_order() -> list[Column]:
    return [tier_order(F.col("gate.tier")).asc(), *score_order()]


def numbered(df: DataFrame, name: str, by: Sequence, order: Sequence[Column]) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def with_company_key(df: DataFrame) -> DataFrame:
    fallback = F.concat_ws("|", "ticker", "country")
    return df.withColumn("company_key", company_key(F.col("name"), fallback))


def best_per_company(scored: DataFrame, by: Sequence[str] = ("strategy",), keep: int = 1) -> DataFrame:
    """The ``keep`` best rows per company key, numbered ``company_row``."""
    ranked = numbered(
        with_company_key(scored), "company_row", [*by, "company_key"], score_order()
    )
    return ranked.where(F.col("company_row") <= keep)


def top_k(
    df: DataFrame, k: int, by: Sequence[str], order: Sequence[Column],
    coarse: Sequence[Column] = (), name: str = "rank",
) -> DataFrame:
    """The k best rows per group, numbered ``name`` from 1.

    A list that is too long for Spark's window limit is selected without a group in one task; ``coarse`` then
    gives the leading columns of ``order`` as values that rise from the best row on and repeat often.
    """
    if k <= most_window_rows(df):
        return numbered(df, name, by, order).where(F.col(name) <= k)
    if not coarse:
        raise ValueError(f"a list of {k} rows needs the coarse keys of its order")
    return numbered_by_range(_reaching(df, k, by, coarse), name, by, order).where(F.col(name) <= k)


def score_keys() -> list[Column]:
    """The coarse keys of ``score_order``: scores have two decimals."""
    return [-F.col("total")]


def tier_score_keys() -> list[Column]:
    return [tier_order(F.col("gate.tier")), *score_keys()]


def _reaching(df: DataFrame, k: int, by: Sequence[str], coarse: Sequence[Column]) -> DataFrame:
    """Rows of each group that fewer than k rows come before by the coarse keys.

    Rows are counted per key where they lie, so the window sees as many rows of a group as it has different
    scores, whatever its size.
    """
    keys = [f"_key{i}" for i in range(len(coarse))]
    valued = df.withColumns(dict(zip(keys, coarse)))
    counts = valued.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).where(F.col("_before") < k)
    # Up to k different keys a group reach this side; the group itself may be anything.
    wanted = first.select(*(F.col(n).alias(f"_{i}") for i, n in enumerate([*by, *keys])))
    same = [F.col(n).eqNullSafe(F.col(f"_{i}")) for i, n in enumerate([*by, *keys])]
    return valued.join(wanted, reduce(Column.__and__, same), "left_semi").drop(*keys)


def numbered_by_range(df: DataFrame, name: str, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``numbered`` by a range sort: a row's number is its place in its part plus what earlier parts hold."""
    every = [*(F.col(n).asc() for n in by), *order]
    ordered = checkpointed(
        df.repartitionByRange(*every).sortWithinPartitions(*every)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_at", 33))
    held = ordered.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")
    shifts = held.select(*(F.col(n).alias(f"_by{i}") for i, n in enumerate(by)), F.col("_part").alias("_of"),
                         (before - F.col("_first") + 1).alias("_shift"))
    same = [F.col(n).eqNullSafe(F.col(f"_by{i}")) for i, n in enumerate(by)] + [F.col("_part") == F.col("_of")]
    placed = ordered.join(shifts, reduce(Column.__and__, same))
    return placed.withColumn(name, (F.col("_at") + F.col("_shift")).cast("int")).select(*df.columns, name)


def normalise_quotas(quotas: Mapping[str, int] | None) -> dict[str, int]:
    """Upper-case countries in the given order; quotas of zero or less ask for nothing."""
    clean: dict[str, int] = {}
    for country, count in (quotas or {}).items():
        if count > 0:
            clean[country.upper()] = count
    return clean


def select_top(
    ideas: DataFrame,
    limit: int,
    quotas: Mapping[str, int] | None = None,
    by: Sequence[str] = ("strategy",),
    order: Sequence[Column] | None = None,
    coarse: Sequence[Column] | None = None,
) -> DataFrame:
    """Top ``limit`` rows per group, with at least the given number of rows per country.

    A quota that the plain top-k misses is met by replacing the lowest-ranked rows of countries
    that have rows to spare. ``rank`` numbers the selection in the given order.
    """
    wanted = normalise_quotas(quotas)
    if limit < 1:
        raise ValueError("limit must be at least 1")
    coarse = coarse or (score_keys() if order is None else ())
    order = order or score_order()
    if not wanted:
        return top_k(ideas, limit, by, order, coarse)
    # No selection can hold more than this many rows of one country, so the pool that the
    # remaining windows see is bounded by countries x k per group.
    k = max(limit, *wanted.values())
    pool = top_k(ideas, k, [*by, "country"], order, coarse, "country_row")
    if sum(wanted.values()) <= limit:
        chosen = _protected_quota(pool, limit, wanted, by, order, coarse)
    elif k > most_window_rows(ideas):
        raise ValueError(f"quotas that exceed the list are met for lists up to {most_window_rows(ideas)} rows")
    else:
        chosen = _swapped_quota(pool, limit, wanted, by, order)
    return top_k(chosen.drop("country_row"), limit, by, order, coarse)


def _quota_of(wanted: Mapping[str, int]) -> Column:
    quota = F.lit(0)
    for country, count in wanted.items():
        quota = F.when(F.col("country") == country, count).otherwise(quota)
    return quota


def _protected_quota(pool, limit, wanted, by, order, coarse) -> DataFrame:
    """Quotas that fit together: the best of each country first, the rest by overall order."""
    rest = (F.col("country_row") > _quota_of(wanted)).cast("int")
    keys = [rest, *coarse] if coarse else ()
    return top_k(pool, limit, by, [rest.asc(), *order], keys, "selection_row").drop("selection_row")


def _swapped_quota(pool, limit, wanted, by, order) -> DataFrame:
    """Any quotas, in their order: swap spare low-ranked rows for the country's next best."""
    c = F.col
    group = Window.partitionBy(*by)
    df = numbered(pool, "position", by, order).withColumn("selected", c("position") <= limit)
    for country, quota in wanted.items():
        mine = c("country") == country
        df = df.withColumns(
            {
                "held": F.sum((c("selected") & mine).cast("int")).over(group),
                "class_row": F.row_number().over(
                    Window.partitionBy(*by, "country", "selected").orderBy("position")
                ),
            }
        )
        df = df.withColumns(
            {
                "spare": c("selected") & (c("class_row") > _quota_of(wanted)),
                "fresh": ~c("selected") & mine & (c("position") > limit),
            }
        )
        df = df.withColumns(
            {
                "spare_row": F.row_number().over(group.orderBy(c("spare").desc(), c("position").desc())),
                "fresh_row": F.row_number().over(group.orderBy(c("fresh").desc(), c("position"))),
                "swaps": F.least(
                    F.greatest(F.lit(quota) - c("held"), F.lit(0)),
                    F.sum(c("spare").cast("int")).over(group),
                    F.sum(c("fresh").cast("int")).over(group),
                ),
            }
        )
        leaves = c("spare") & (c("spare_row") <= c("swaps"))
        joins = c("fresh") & (c("fresh_row") <= c("swaps"))
        df = df.withColumn("selected", (c("selected") & ~leaves) | joins)
    return df.where("selected").drop(
        "position", "selected", "held", "class_row", "spare", "fresh", "spare_row", "fresh_row",
        "swaps",
    )
