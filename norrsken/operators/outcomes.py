"""Snapshots, due dates, outcome states and the equal-weight country benchmark."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from norrsken import constants as K
from norrsken.functions.dates import add_weekdays
from norrsken.functions.numeric import round_dp
from norrsken.schemas import OUTCOMES, SNAPSHOTS, conform
from norrsken.session import sorted_side


def pick_id(report_date: Column, strategy: Column, country: Column, ticker: Column) -> Column:
    return F.concat_ws("|", report_date.cast("string"), strategy, country, ticker)


def market_snapshot(quotes: DataFrame, snapshot_date: dt.date | Column | None = None) -> DataFrame:
    """Quotes with price and currency as snapshot rows, keys upper-cased.

    ``snapshot_date`` is a day for the whole frame, or None if the frame has the column.
    """
    df = quotes.where("price is not null and currency is not null")
    if snapshot_date is not None:
        day = snapshot_date if isinstance(snapshot_date, Column) else F.lit(snapshot_date)
        df = df.withColumn("snapshot_date", day.cast("date"))
    none = F.array().cast("array<string>")
    return conform(
        df.withColumns(
            {
                "ticker": F.upper("ticker"),
                "country": F.upper("country"),
                "catalysts": F.coalesce("catalysts", none),
                "risks": F.coalesce("risks", none),
            }
        ),
        SNAPSHOTS,
    )


def with_horizons(picks: DataFrame) -> DataFrame:
    """One row per pick and horizon, with the due date."""
    grid = F.array(
        *(
            F.struct(F.lit(name).alias("horizon"), F.lit(days).alias("horizon_days"))
            for name, days in K.HORIZONS.items()
        )
    )
    df = picks.select("*", F.inline(grid))
    return df.withColumn("due_date", add_weekdays(F.col("report_date"), F.col("horizon_days")))


def open_outcomes(picks: DataFrame) -> DataFrame:
    """The empty outcomes of new picks."""
    return conform(with_horizons(picks).withColumn("status", F.lit(K.NOT_DUE)), OUTCOMES)


def country_benchmark(snapshots: DataFrame, spans: DataFrame) -> DataFrame:
    """Mean return of all peers present on both days in the same currency, per span.

    ``spans`` holds the wanted (country, report_date, due_date) combinations. It is reduced to
    distinct spans first, so the peers are joined once per span and not once per pick. One country
    may hold most rows of a day: the spans, which grow with countries and days alone, go to where
    the quotes lie, the join with the last quotes has the ticker in its key, and gains are summed
    in its tasks before country and days meet. The mean is summed as decimals: the result does not
    depend on how rows met in partitions.
    """
    spans = F.broadcast(spans.select("country", "report_date", "due_date").distinct())
    quotes = snapshots.select("country", "ticker", "snapshot_date", "price", "currency")
    entry = quotes.where("price is not null and price <> 0").select(
        "country", "ticker", F.col("snapshot_date").alias("report_date"),
        F.col("price").alias("from_price"), "currency",
    )
    last = quotes.where("price is not null").select(
        "country", "ticker", F.col("snapshot_date").alias("due_date"),
        F.col("price").alias("to_price"), "currency",
    )
    gain = (F.col("to_price") - F.col("from_price")) / F.col("from_price") * 100.0
    sums = (
        entry.join(spans, ["country", "report_date"])
        .join(sorted_side(last), ["country", "ticker", "due_date", "currency"])
        .groupBy("country", "report_date", "due_date")
        .agg(
            F.sum(F.round(gain, 8).try_cast("decimal(24,8)")).alias("gains"),
            # Beyond the decimal's range the sum of such gains is a double: one odd quote ends no run.
            F.sum(F.when(gain.try_cast("decimal(24,8)").isNull(), gain)).alias("odd_gains"),
            F.count("*").alias("peers"),
        )
    )
    return sums.select(
        "country", "report_date", "due_date", "peers",
        round_dp((F.coalesce(F.col("gains").cast("double"), F.lit(0.0)) + F.coalesce("odd_gains", F.lit(0.0)))
                 / F.col("peers"), 2).alias("benchmark_return_pct"),
    )


def run_date_index(run_dates: DataFrame) -> DataFrame:
    """Every calendar day up to the last run, with the first run on or after it.

    Turns "the first run at or after the due date" into an equality join. There is one row per
    calendar day, so the single window over the run dates stays small however large the ledger.
    """
    previous = F.lag("run_date").over(Window.orderBy("run_date"))
    spans = run_dates.select("run_date").distinct().withColumn("previous", previous)
    # Days before the first run are answered by the caller: their first run is the first of all.
    first_day = F.coalesce(F.date_add("previous", 1), F.col("run_date"))
    days = F.sequence(first_day, F.col("run_date"))
    return spans.select(F.explode(days).alias("due_date"), F.col("run_date").alias("as_of_date"))


def settle(due: DataFrame, quotes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Status, price and returns of rows that have a due date and the run that decides them.

    ``quotes`` must not be filtered: a quote without price is still reported as missing.
    """
    c = F.col
    prices = quotes.select(
        "ticker", "country", c("quote_date").alias("due_date"),
        c("price").alias("quote_price"), c("currency").alias("quote_currency"),
    )
    on_time = c("as_of_date") == c("due_date")
    df = due.join(sorted_side(prices), ["ticker", "country", "due_date"], "left")
    usable = (
        c("quote_price").isNotNull()
        & c("entry_price").isNotNull()
        & (c("entry_price") != 0)
        & (c("quote_currency") == c("entry_currency"))
    )
    status = (
        F.when(c("as_of_date").isNull(), K.NOT_DUE)
        .when(~on_time, K.MISSED_WINDOW)
        .when(usable, K.PRICED)
        .otherwise(K.MISSING_PRICE)
    )
    change = (c("quote_price") - c("entry_price")) / F.nullif(c("entry_price"), F.lit(0.0)) * 100.0
    df = df.withColumn("status", status).withColumns(
        {
            "price": F.when(on_time, c("quote_price")),
            "currency": F.when(on_time & c("quote_price").isNotNull(), c("quote_currency")),
            "return_pct": F.when(c("status") == K.PRICED, round_dp(change, 2)),
        }
    )
    benchmark = country_benchmark(snapshots, due.where(on_time)).drop("peers")
    df = df.join(benchmark, ["country", "report_date", "due_date"], "left")
    compared = (c("status") == K.PRICED) & c("benchmark_return_pct").isNotNull()
    label = F.concat(F.lit("Equal-weight "), c("country"), F.lit(" market"))
    excess = round_dp(c("return_pct") - c("benchmark_return_pct"), 2)
    return df.withColumns(
        {
            "benchmark_label": F.when(compared, label),
            "excess_return_pct": F.when(compared, excess),
            "benchmark_return_pct": F.when(compared, c("benchmark_return_pct")),
        }
    ).drop("quote_price", "quote_currency")


def evaluate_history(
    picks: DataFrame, quotes: DataFrame, snapshots: DataFrame, run_dates: DataFrame
) -> DataFrame:
    """Outcomes of all picks over a whole history of runs, in one pass.

    For every pick and horizon the first run on or after the due date decides: on the day itself
    the quote is taken, a later run finds a missed window, no run leaves the row not due. Pick
    columns stay in the result.
    """
    first_run = run_dates.agg(F.min("run_date").alias("first_run"))
    due = with_horizons(picks).join(run_date_index(run_dates), "due_date", "left")
    # A due date before the first run was missed by it.
    earliest = first_run.scalar()
    as_of = F.coalesce("as_of_date", F.when(F.col("due_date") < earliest, earliest))
    return settle(due.withColumn("as_of_date", as_of), quotes, snapshots)


def update_due(
    outcomes: DataFrame,
    picks: DataFrame,
    quotes: DataFrame,
    snapshots: DataFrame,
    as_of: dt.date,
) -> DataFrame:
    """One run: settle not-due rows whose due date has come; all other states are final.

    A company without quote on the day is a missing price. A run without any price source is not
    a run: callers leave it out, so that rows due that day stay open.
    """
    c = F.col
    today = F.lit(as_of).cast("date")
    day_quotes = quotes.where(c("quote_date") == today)
    moves = (c("status") == K.NOT_DUE) & (c("due_date") <= today)
    entry = picks.select(
        "pick_id", "report_date", "ticker", "country", "entry_price", "entry_currency"
    )
    keyed = outcomes.withColumn("moves", moves)
    moving = (
        keyed.where("moves")
        .select("pick_id", "report_date", "horizon", "due_date", today.alias("as_of_date"))
        .join(sorted_side(entry), ["pick_id", "report_date"])
    )
    window = snapshots.where(c("snapshot_date") <= today)
    settled = conform(settle(moving, day_quotes, window), OUTCOMES)
    return conform(keyed.where(~c("moves")), OUTCOMES).unionByName(settled)
