"""Watchlists: research to ranked rows, for several strategies and run dates in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from norrsken.operators.conviction import with_conviction
from norrsken.operators.enrichment import first_hits, merge_fundamentals
from norrsken.operators.quality import tier_order
from norrsken.operators.ranking import (
    best_per_company,
    company_filter,
    normalise_quotas,
    score_keys,
    score_order,
    select_top,
    tier_score_order,
    top_k,
    with_company_key,
)
from norrsken.operators.scoring import normalise_strategies, strategy_scores
from norrsken.operators.signals import has_trading_setup
from norrsken.schemas import COMPANY_COLUMNS, METRIC_COLUMNS
from norrsken.session import checkpointed

RESEARCH_COLUMNS = (
    *COMPANY_COLUMNS, "price", "price_currency", *METRIC_COLUMNS, "catalysts", "risks",
    "evidence", "data_quality", "ordinal",
)


def scored_ideas(research: DataFrame, strategies: Sequence[str]) -> DataFrame:
    """Scores per strategy; trading keeps only companies with a trading setup."""
    scored = strategy_scores(research, strategies)
    if "trading" in strategies:
        setup = has_trading_setup(F.col("catalysts"))
        scored = scored.where((F.col("strategy") != "trading") | setup)
    return scored


def final_order(strategies: Sequence[str]) -> list:
    """Long-term ranks by gate tier first. Tier counts for that strategy only."""
    if "long-term" not in strategies:
        return score_order()
    if tuple(strategies) == ("long-term",):
        return tier_score_order()
    tier, *rest = tier_score_order()
    own = F.when(F.col("strategy") == "long-term", tier_order(F.col("gate.tier"))).otherwise(0)
    return [own.asc(), *rest]


def final_keys(strategies: Sequence[str]) -> list:
    """The coarse keys of ``final_order``."""
    if "long-term" not in strategies:
        return score_keys()
    own = F.when(F.col("strategy") == "long-term", tier_order(F.col("gate.tier"))).otherwise(0)
    return [own, *score_keys()]


def watchlist(
    research: DataFrame,
    strategies: str | Sequence[str] = "balanced",
    limit: int = 20,
    countries: Sequence[str] | None = ("SE", "FI"),
    include_first_north: bool = True,
    min_market_cap: float | None = None,
    max_market_cap: float | None = None,
    sector: str | None = None,
    min_country_counts: Mapping[str, int] | None = None,
    fundamentals: DataFrame | None = None,
    enrichment_budget: int | None = None,
    run_columns: Sequence[str] = (),
) -> DataFrame:
    """Ranked top ``limit`` ideas per strategy (and per ``run_columns``, such as a run date).

    With ``fundamentals`` and a budget, the best ``enrichment_budget`` ideas are enriched and
    rescored before the final ranking.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    names = normalise_strategies(strategies)
    by = ["strategy", *run_columns]
    filtered = company_filter(
        research.select(*RESEARCH_COLUMNS, *run_columns), countries, include_first_north, min_market_cap, max_market_cap, sector
    )
    scored = scored_ideas(filtered, names)
    order = final_order(names)
    if fundamentals is None or not enrichment_budget or enrichment_budget < 1:
        return select_top(best_per_company(scored, by), limit, min_country_counts, by, order, final_keys(names))
    return _enriched(
        scored, names, limit, min_country_counts, fundamentals, enrichment_budget, by, order
    )


def enrichment_candidates(
    scored: DataFrame,
    limit: int,
    budget: int,
    min_country_counts: Mapping[str, int] | None = None,
    by: Sequence[str] = ("strategy",),
) -> DataFrame:
    """The ideas worth a fundamentals lookup: dedupe, rank, quota, then the first ``budget``.

    The order is plain score order for every strategy, and the quota applies before the cut.
    """
    ideas = best_per_company(scored, by)
    return select_top(ideas, limit, min_country_counts, by).where(F.col("rank") <= budget)


def _enriched(scored, names, limit, quotas, fundamentals, budget, by, order) -> DataFrame:
    """Enrich the candidates, then rank them against what could still reach the list.

    After rescoring only three kinds of row can be on the list: the candidates, the runner-up of
    a candidate's company (another share class), and the best other companies. All are among the
    first ``k + budget`` ideas per country. Scored rows are written once under a row number; only
    numbers and the columns of the order are shuffled and sorted by company, so no sort holds whole
    rows. What is left is bounded by the limits; its rows are fetched by number and checkpointed, and
    lookup, rescoring and ranking run on them.
    """
    c = F.col
    k = max(limit, *normalise_quotas(quotas).values(), 1) + budget
    columns = [*by, *RESEARCH_COLUMNS, "company_key", "total"]
    if "long-term" in names:
        columns.append("gate")
    score_columns = [n for n in scored.columns if n not in columns]
    scored = checkpointed(with_company_key(scored).withColumn("row_number", F.monotonically_increasing_id()))
    narrow = ["row_number", *by, "name", "ticker", "country", "ordinal", "total"]
    if "long-term" in names:
        narrow.append(F.struct("gate.tier").alias("gate"))
    same_company = Window.partitionBy(*by, "company_key").orderBy("company_row")
    two_best = best_per_company(scored.select(*narrow), by, keep=2)
    winners = two_best.withColumn("runner_up", F.lead("row_number").over(same_company)).where("company_row = 1")
    numbers = top_k(winners, k, [*by, "country"], score_order()).select("row_number", "runner_up")
    if "long-term" in names:
        by_tier = top_k(winners, k, [*by, "country"], order).select("row_number", "runner_up")
        numbers = numbers.unionByName(by_tier).distinct()
    numbers = checkpointed(numbers)
    both = numbers.select("row_number").unionByName(numbers.select(c("runner_up").alias("row_number")))
    rows = checkpointed(scored.join(both.distinct(), "row_number"))
    pool = rows.join(numbers, "row_number").drop("row_number")

    chosen = select_top(pool, limit, quotas, by).where(c("rank") <= budget).drop("rank")
    keys = chosen.select(*by, "company_key")
    base = chosen.select(c("strategy").alias("chosen_for"), *by[1:], *RESEARCH_COLUMNS)
    hits = first_hits(base.select("ticker", "country").distinct(), fundamentals)
    rescored = strategy_scores(merge_fundamentals(base, hits), names)
    rescored = with_company_key(rescored.where("strategy = chosen_for"))
    wanted = [*columns, *score_columns]
    runners_up = rows.join(chosen.select(c("runner_up").alias("row_number")), "row_number")
    others = pool.join(keys, [*by, "company_key"], "left_anti")
    rivals = (
        rescored.select(*wanted)
        .unionByName(runners_up.select(*wanted))
        .unionByName(others.select(*wanted))
    )
    return select_top(best_per_company(rivals, by), limit, quotas, by, order)


def with_report_columns(ranked: DataFrame) -> DataFrame:
    """Adds conviction for long-term rows, null for the other strategies."""
    if "gate" not in ranked.columns:
        return ranked
    df = with_conviction(ranked)
    own = F.col("strategy") == "long-term"
    return df.withColumns(
        {"conviction": F.when(own, F.col("conviction")), "gate": F.when(own, F.col("gate"))}
    )
