"""Scorecard, signal attribution, best and worst picks, market tone, suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from norrsken import constants as K
from norrsken.functions.numeric import percent_text, round_dp
from norrsken.functions.rules import first_match
from norrsken.functions.text import (
    has_signal,
    pick_company_key,
    searchable,
    signal_key,
    signal_label,
)
from norrsken.operators.ranking import numbered, top_k
from norrsken.session import sorted_side

ALL_STRATEGIES = "all"


def _cents(pct: Column) -> Column:
    """Percentages are published with two decimals, so hundredths are exact whole numbers."""
    return F.rint(pct * 100.0).cast("long")


def completed(outcomes: DataFrame) -> DataFrame:
    return outcomes.where((F.col("status") == K.PRICED) & F.col("return_pct").isNotNull())


def _mean(total: str, n: str) -> Column:
    return round_dp(F.col(total).cast("double") / 100.0 / F.nullif(F.col(n), F.lit(0)), 2)


def _share(part: str, n: str) -> Column:
    return round_dp(F.col(part) / F.nullif(F.col(n), F.lit(0)) * 100.0, 1)


#: Mergeable state of the scorecard: rows of different days and runs add up.
TALLIES = StructType(
    [
        StructField("strategy", StringType()),
        StructField("horizon", StringType()),
        StructField("due_date", DateType()),
        StructField("cents", LongType()),
        *(
            StructField(name, LongType())
            for name in ("n", "benchmark_cents", "benchmarks", "excess_cents", "excesses", "excess_hits")
        ),
    ]
)
_COUNTS = TALLIES.names[4:]


def _tallied(outcomes: DataFrame, *by: str) -> DataFrame:
    c = F.col
    return (
        completed(outcomes)
        .groupBy(*by, _cents(c("return_pct")).alias("cents"))
        .agg(
            F.count("*").alias("n"),
            F.sum(_cents(c("benchmark_return_pct"))).alias("benchmark_cents"),
            F.count("benchmark_return_pct").alias("benchmarks"),
            F.sum(_cents(c("excess_return_pct"))).alias("excess_cents"),
            F.count("excess_return_pct").alias("excesses"),
            F.count_if(c("excess_return_pct") > 0).alias("excess_hits"),
        )
    )


def return_tallies(outcomes: DataFrame) -> DataFrame:
    """Completed outcomes counted per strategy, horizon, due day and return in hundredths of a percent.

    Any number of picks becomes as many rows as there are distinct returns. Counts of further days are
    rows of their own, so the figures of any range of days come from these without the outcomes.
    """
    return _tallied(outcomes, "strategy", "horizon", "due_date")


def horizon_scorecard(
    outcomes: DataFrame, strategies: Sequence[str] = K.TRACKED_STRATEGIES
) -> DataFrame:
    """Counts, hit and loss rates, mean, median, spread and benchmark per strategy and horizon."""
    return _scorecard(_tallied(outcomes, "strategy", "horizon"), strategies)


def scorecard_of(tallies: DataFrame, strategies: Sequence[str] = K.TRACKED_STRATEGIES) -> DataFrame:
    """The scorecard out of ``return_tallies`` of any days."""
    counts = (F.sum(name).alias(name) for name in _COUNTS)
    return _scorecard(tallies.groupBy("strategy", "horizon", "cents").agg(*counts), strategies)


def _scorecard(tallies: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Figures out of one row per strategy, horizon and return in hundredths.

    Median and spread come exactly out of the counts: no group's raw returns ever meet in one place.
    """
    c = F.col
    group = ["strategy", "horizon"]
    n, cents = c("n"), c("cents")
    exact, weight = cents.cast("decimal(14,0)"), n.cast("decimal(18,0)")
    # The two middle values: where the running count reaches, and passes, half of the rows.
    by_value = Window.partitionBy(*group).orderBy("cents")
    running = F.sum("n").over(by_value.rowsBetween(Window.unboundedPreceding, 0)) * 2
    everything = F.sum("n").over(Window.partitionBy(*group))
    tallies = tallies.withColumns({"running": running, "everything": everything})
    stats = tallies.groupBy(*group).agg(
        F.sum("n").alias("completed"),
        F.sum(F.when(cents > 0, n).otherwise(0)).alias("hits"),
        F.sum(F.when(cents < 0, n).otherwise(0)).alias("losses"),
        F.sum(F.when(cents <= -1000, n).otherwise(0)).alias("large_loser_count"),
        F.sum(exact * weight).alias("sum_cents"),
        F.sum((exact * exact).cast("decimal(28,0)") * weight).alias("sum_squares"),
        F.min("cents").alias("least"),
        F.min(F.when(c("running") >= c("everything"), cents)).alias("low_middle"),
        F.min(F.when(c("running") > c("everything"), cents)).alias("high_middle"),
        *(
            F.sum(name).alias(name)
            for name in ("benchmark_cents", "benchmarks", "excess_cents", "excesses", "excess_hits")
        ),
    )
    count, total = c("completed").cast("double"), c("sum_cents").cast("double")
    variance = c("sum_squares").cast("double") / count - (total / count) * (total / count)
    figures = stats.select(
        *group,
        "completed",
        _share("hits", "completed").alias("hit_rate_pct"),
        _mean("sum_cents", "completed").alias("average_return_pct"),
        round_dp((c("low_middle") / 100.0 + c("high_middle") / 100.0) / 2.0, 2).alias(
            "median_return_pct"
        ),
        round_dp(c("least") / 100.0, 2).alias("worst_return_pct"),
        _share("losses", "completed").alias("loss_rate_pct"),
        "large_loser_count",
        round_dp(F.sqrt(F.greatest(variance, F.lit(0.0))) / 100.0, 2).alias("volatility_pct"),
        _mean("benchmark_cents", "benchmarks").alias("average_benchmark_return_pct"),
        _mean("excess_cents", "excesses").alias("average_excess_return_pct"),
        _share("excess_hits", "excesses").alias("excess_hit_rate_pct"),
    )
    cells = [
        F.struct(F.lit(s).alias("strategy"), F.lit(h).alias("horizon"), F.lit(d).alias("horizon_days"))
        for s in strategies
        for h, d in K.HORIZONS.items()
    ]
    grid = tallies.sparkSession.range(1).select(F.inline(F.array(*cells)))
    return grid.join(figures, group, "left").withColumns(
        {
            "completed": F.coalesce("completed", F.lit(0)),
            "large_loser_count": F.coalesce("large_loser_count", F.lit(0)),
        }
    )


def latest_returns(outcomes: DataFrame) -> DataFrame:
    """Per pick the return at the longest completed horizon."""
    days = F.lit(0)
    for name, length in K.HORIZONS.items():
        days = F.when(F.col("horizon") == name, length).otherwise(days)
    return completed(outcomes).groupBy("pick_id").agg(
        F.max_by("return_pct", days).alias("latest_return_pct")
    )


def _tagged(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), value.cast("string"))


def _quality_reason(reason: Column) -> Column:
    """Reasons that count as a quality signal, under their published name."""
    return first_match(
        (reason.startswith("Positive operating margin"), F.lit("quality:positive operating margin")),
        (reason.startswith("Revenue growth"), F.lit("quality:revenue growth")),
        (
            reason.isin(
                "Conservative balance sheet", "Conservative debt/equity", "Net cash balance sheet"
            ),
            F.lit("quality:conservative balance sheet"),
        ),
        (reason == "Attractive valuation support", F.lit("quality:attractive valuation")),
        (
            reason == "Business description available",
            F.lit("quality:business description available"),
        ),
        otherwise=F.lit(None).cast("string"),
    )


def pick_signals() -> Column:
    """Distinct signals of a pick. Needs the pick columns."""
    c = F.col
    none = F.array().cast("array<string>")
    long_term = c("strategy") == "long-term"
    bucket, gate = c("long_term_conviction.bucket"), c("long_term_gate")
    quality_bucket = long_term & F.coalesce(bucket != "", F.lit(False))
    reasons, warnings, risks = (F.coalesce(n, none) for n in ("reasons", "warnings", "risks"))
    # A reason that only repeats the bucket is dropped where the bucket is a signal itself.
    kept = F.filter(
        reasons,
        lambda r: ~F.coalesce(quality_bucket & (signal_key(r) == signal_key(bucket)), F.lit(False)),
    )
    gaps = F.filter(
        F.transform(F.concat(warnings, risks), signal_key), lambda x: x.isin(*K.PROOF_GAPS)
    )
    kind = gate["valuation"]["primary_kind"]
    own = F.concat(
        F.array(
            F.when(gate["tier"] != "", _tagged("gate", gate["tier"])),
            _tagged("gate_durable_anchors", gate["durable_anchor_count"]),
            _tagged("gate_severe_proof_gaps", gate["severe_proof_gap_count"]),
            F.when(kind != "", _tagged("valuation_proxy", kind)),
            F.when(quality_bucket, _tagged("quality_bucket", bucket)),
        ),
        F.transform(reasons, _quality_reason),
        F.transform(gaps, lambda x: _tagged("proof_gap", x)),
    )
    everything = F.concat(
        F.array(
            _tagged("country", F.coalesce("country", F.lit("None"))),
            _tagged("segment", F.coalesce("segment", F.lit("None"))),
            F.when(
                c("long_term_conviction").isNotNull() & ~quality_bucket,
                _tagged("bucket", F.coalesce(bucket, F.lit("None"))),
            ),
        ),
        F.transform(kept, lambda r: _tagged("reason", r)),
        F.when(long_term, own).otherwise(none),
    )
    return F.array_distinct(F.array_compact(everything))


def signal_attribution(picks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Observations, mean and hit rate per signal, overall and per strategy.

    The exploded signals are aggregated once per (strategy, signal); the overall level is built
    from those few rows. Country and segment signals are held by most picks, and map-side partial
    aggregation reduces them before the shuffle.
    """
    c = F.col
    rated = picks.join(sorted_side(latest_returns(outcomes)), "pick_id")
    cents = _cents(c("latest_return_pct"))
    per_strategy = (
        rated.select("strategy", cents.alias("cents"), F.explode(pick_signals()).alias("signal"))
        .groupBy("strategy", "signal")
        .agg(
            F.count("*").alias("observations"),
            F.sum("cents").alias("sum_cents"),
            F.count_if(c("cents") > 0).alias("hits"),
        )
    )
    tag = F.struct(
        F.lit(ALL_STRATEGIES).alias("scope"), _tagged("strategy", c("strategy")).alias("signal")
    )
    # Every pick carries exactly one country signal, so these rows also give the strategy signal.
    counted = F.array(
        F.struct(c("strategy").alias("scope"), "signal"),
        F.struct(F.lit(ALL_STRATEGIES).alias("scope"), "signal"),
    )
    with_strategy = F.when(
        c("signal").startswith("country:"), F.concat(counted, F.array(tag))
    ).otherwise(counted)
    return (
        per_strategy.select(F.inline(with_strategy), "observations", "sum_cents", "hits")
        .groupBy("scope", "signal")
        .agg(
            F.sum("observations").alias("observations"),
            F.sum("sum_cents").alias("sum_cents"),
            F.sum("hits").alias("hits"),
        )
        .select(
            "scope", "signal", "observations",
            _mean("sum_cents", "observations").alias("average_return_pct"),
            _share("hits", "observations").alias("hit_rate_pct"),
        )
    )


def signal_order() -> list[Column]:
    return [F.col("observations").desc(), F.col("signal").asc()]


def top_signals(attribution: DataFrame, k: int = 12) -> DataFrame:
    return top_k(attribution, k, ["scope"], signal_order())


def learning_suggestions(attribution: DataFrame, minimum: int = 10, k: int = 5) -> DataFrame:
    """Text for the best-observed signals per scope; one notice where no signal qualifies."""
    c = F.col
    best = top_k(attribution.where(c("observations") >= minimum), k, ["scope"], signal_order())
    direction = F.when(c("average_return_pct") > 0, "positive").otherwise("negative")
    words = F.concat(
        signal_label(c("signal")), F.lit(" has produced a "), direction,
        F.lit(" average return of "), percent_text(c("average_return_pct"), signed=True),
        F.lit(" across "), c("observations").cast("string"),
        F.lit(" completed observations. Review whether its scoring weight should change."),
    )
    scopes = attribution.sparkSession.range(1).select(
        F.explode(F.array(*(F.lit(s) for s in (ALL_STRATEGIES, *K.TRACKED_STRATEGIES)))).alias("scope")
    )
    notice = (
        f"No learning suggestions yet. At least {minimum} completed observations are needed for "
        "a signal."
    )
    chosen = best.select("scope", "rank", "signal", words.alias("suggestion"))
    return scopes.join(chosen, "scope", "left").select(
        "scope",
        F.coalesce("rank", F.lit(1)).alias("rank"),
        "signal",
        F.coalesce("suggestion", F.lit(notice)).alias("suggestion"),
    )


def _ranked_picks(outcomes: DataFrame, best: bool, k: int) -> DataFrame:
    c = F.col
    days = F.lit(0)
    for name, length in K.HORIZONS.items():
        days = F.when(c("horizon") == name, length).otherwise(days)
    scopes = F.explode(F.array(F.lit(ALL_STRATEGIES), c("strategy"))).alias("scope")
    rows = completed(outcomes).select(
        scopes, "pick_id", "name", "ticker", "strategy", "report_url", "horizon",
        days.alias("horizon_days"), "return_pct",
        pick_company_key(c("name"), c("ticker")).alias("company_key"),
    )
    # Ties: pick order, then horizons in the order 1, 5, 20, 60 days.
    value = c("return_pct").desc() if best else c("return_pct").asc()
    order = [value, c("pick_id").asc(), c("horizon_days").asc()]
    one_each = numbered(rows, "company_row", ["scope", "company_key"], order)
    one_each = one_each.where("company_row = 1").drop("company_row")
    return top_k(one_each, k, ["scope"], order).drop("horizon_days")


def best_picks(outcomes: DataFrame, k: int = 5) -> DataFrame:
    """Best completed returns, one per company, overall and per strategy."""
    return _ranked_picks(outcomes, True, k)


def worst_picks(outcomes: DataFrame, k: int = 5) -> DataFrame:
    return _ranked_picks(outcomes, False, k)


def worst_not_best(worst: DataFrame, best: DataFrame) -> DataFrame:
    """The worst list without companies on the best list. May be shorter than the list size."""
    shown = best.select("scope", "company_key")
    return worst.join(shown, ["scope", "company_key"], "left_anti")


def market_tone(movers: Column, selloffs: Column) -> Column:
    return (
        F.when((movers >= 2) & (movers >= selloffs * 2), "Risk-on / broad momentum")
        .when((selloffs >= 2) & (selloffs >= movers * 2), "Risk-off / broad selloff")
        .otherwise("Mixed / quiet")
    )


def is_mover() -> Column:
    return has_signal(searchable(F.col("catalysts")), "intraday momentum")


def is_selloff() -> Column:
    return has_signal(searchable(F.col("risks")), K.SHARP_SELLOFF)


def is_active() -> Column:
    joined = searchable(F.col("catalysts"))
    return has_signal(joined, K.HIGH_TURNOVER) | has_signal(joined, K.MODERATE_TURNOVER)


def daily_market_context(snapshots: DataFrame) -> DataFrame:
    """Companies, movers, selloffs, active turnover and tone per snapshot day."""
    return (
        snapshots.groupBy("snapshot_date")
        .agg(
            F.count("*").alias("companies"),
            F.count_if(is_mover()).alias("positive_movers"),
            F.count_if(is_selloff()).alias("selloffs"),
            F.count_if(is_active()).alias("active_turnover"),
        )
        .withColumn("tone", market_tone(F.col("positive_movers"), F.col("selloffs")))
    )


def latest_market_context(snapshots: DataFrame) -> DataFrame:
    """The context of the latest day. The day is found first, so other partitions are skipped."""
    latest = snapshots.agg(F.max("snapshot_date")).scalar()
    return daily_market_context(snapshots.where(F.col("snapshot_date") == latest))
