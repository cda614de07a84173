"""The ledger's summary: the figures behind each table of the performance page, and their sink."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from norrsken.operators import scorecard as sc
from norrsken.operators.quality import tier_counts
from norrsken.sources.ledger import Ledger


def ledger_summary(ledger: Ledger) -> dict[str, DataFrame]:
    """Six frames as of one version of the ledger.

    ``horizons`` comes from the tallies that runs keep, without reading outcomes again; ``signals``, ``latest`` and
    ``ranked`` (best, and worst without the best's companies) from picks and their outcomes; ``context`` from the
    latest snapshot; ``tiers`` from the long-term picks of each report day.
    """
    version = max(ledger.versions(), default=None)
    pinned = Ledger(ledger.spark, ledger.path, version)
    picks, rows = pinned.table("picks"), pinned.outcomes_with_picks()
    best = sc.best_picks(rows)
    worst = sc.worst_not_best(sc.worst_picks(rows), best)
    gated = picks.where("long_term_gate is not null").select("report_date", F.col("long_term_gate").alias("gate"))
    return {
        "horizons": sc.scorecard_of(pinned.table("tallies")),
        "signals": sc.signal_attribution(picks, rows),
        "context": sc.latest_market_context(pinned.table("snapshots")),
        "tiers": tier_counts(gated, "report_date"),
        "ranked": best.withColumn("list", F.lit("best")).unionByName(worst.withColumn("list", F.lit("worst"))),
        "latest": sc.latest_returns(rows),
    }


def write_summary(frames: Mapping[str, DataFrame], path: str, format: str = "parquet") -> None:
    """Each frame as a folder of its name; a rerun replaces it. JSON keeps null figures as nulls."""
    for name, frame in frames.items():
        writer = frame.write.mode("overwrite").format(format)
        (writer.option("ignoreNullFields", False) if format == "json" else writer).save(f"{path}/{name}")
