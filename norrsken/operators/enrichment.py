"""Fundamentals lookup by symbol candidates, and the merge into base research."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from norrsken.functions.text import symbol_candidates
from norrsken.schemas import EVIDENCE, FILLABLE_METRICS, METRIC_COLUMNS

FUNDAMENTAL_COLUMNS = (
    "market_cap_eur_m", "business_description", "ir_url", *METRIC_COLUMNS,
)
# --- fixed values: a payload with none of these counts as a miss ----------------------------
MEANINGFUL_COLUMNS = (
    "market_cap_eur_m", "pe_ratio", "price_to_book", "revenue_growth_pct",
    "operating_margin_pct", "debt_to_equity", "net_cash_eur_m", "average_daily_value_eur",
    "one_year_return_pct", "distance_from_52w_high_pct",
)


def with_candidates(companies: DataFrame) -> DataFrame:
    """One row per company and lookup symbol, ``attempt`` counting from 0."""
    candidates = symbol_candidates(F.col("ticker"), F.col("country"))
    return companies.select("*", F.posexplode(candidates).alias("attempt", "symbol"))


def one_per_symbol(rows: DataFrame) -> DataFrame:
    """A row per upper-cased symbol (``join_symbol``): the greatest of its rows."""
    whole = F.struct(*rows.columns)
    return (
        rows.groupBy(F.upper("symbol").alias("join_symbol"))
        .agg(F.max(whole).alias("row"))
        .select("join_symbol", "row.*")
    )


def first_hits(companies: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Per company the first candidate symbol with a usable payload.

    ``fundamentals`` holds usable payloads only, as the parsers return them. ``companies`` has one
    row per (ticker, country); at most two candidates each reach the grouping, so no group grows
    with the data. Of several payloads of a symbol the greatest one in column order counts, whatever the partitions.
    """
    usable = one_per_symbol(fundamentals.select("symbol", "evidence_item", *FUNDAMENTAL_COLUMNS))
    attempts = with_candidates(companies.select("ticker", "country")).select(
        "ticker", "country", "attempt", F.upper("symbol").alias("join_symbol")
    )
    hit = F.struct(
        "symbol", "evidence_item", *(F.col(name) for name in FUNDAMENTAL_COLUMNS)
    )
    return (
        attempts.join(usable, "join_symbol")
        .groupBy("ticker", "country")
        .agg(F.min_by(hit, "attempt").alias("hit"), F.min("attempt").alias("hit_attempt"))
        .select("ticker", "country", "hit_attempt", "hit.*")
    )


def with_profile_text(fundamentals: DataFrame, profiles: DataFrame) -> DataFrame:
    """Search hits left-joined with profile text; a hit without profile stays as it is."""
    texts = one_per_symbol(profiles.select("symbol", "business_description", "ir_url")).select(
        "join_symbol",
        F.col("business_description").alias("profile_description"),
        F.col("ir_url").alias("profile_ir_url"),
    )
    return (
        fundamentals.withColumn("join_symbol", F.upper("symbol"))
        .join(texts, "join_symbol", "left")
        .withColumns(
            {
                "business_description": F.coalesce("profile_description", "business_description"),
                "ir_url": F.coalesce("profile_ir_url", "ir_url"),
            }
        )
        .drop("join_symbol", "profile_description", "profile_ir_url")
    )


def merge_fundamentals(research: DataFrame, hits: DataFrame) -> DataFrame:
    """Fill unknown fields only; price, currency and price context are never filled.

    Thin data becomes partial once a number or the market cap was filled. The evidence of the hit
    is appended whether or not it filled anything.
    """
    c = F.col
    found = hits.select(
        "ticker", "country", F.lit(True).alias("was_hit"),
        c("evidence_item").cast(EVIDENCE).alias("hit_evidence"),
        *(c(name).alias(f"hit_{name}") for name in FUNDAMENTAL_COLUMNS),
    )
    numbers = ("market_cap_eur_m", *FILLABLE_METRICS)
    filled = F.greatest(
        *(c(n).isNull() & c(f"hit_{n}").isNotNull() for n in numbers)
    )
    none = F.array().cast(research.schema["evidence"].dataType)
    merged = {
        name: F.coalesce(name, f"hit_{name}")
        for name in (*numbers, "business_description", "ir_url")
    }
    merged["evidence"] = F.concat(
        "evidence", F.when(c("was_hit"), F.array("hit_evidence")).otherwise(none)
    )
    merged["data_quality"] = F.when(
        (c("data_quality") == "thin") & filled, "partial"
    ).otherwise(c("data_quality"))
    return (
        research.join(found, ["ticker", "country"], "left")
        .withColumns(merged)
        .select(*research.columns)
    )


def coverage(companies: DataFrame, fundamentals: DataFrame, source: str) -> DataFrame:
    """Attempted and parsed symbol lookups of one source, with status.

    Lookups of a company stop at the first hit, so a hit at attempt n means n + 1 lookups.
    """
    c = F.col
    hits = first_hits(companies, fundamentals).select("ticker", "country", "hit_attempt")
    tried = F.size(symbol_candidates(c("ticker"), c("country")))
    return (
        companies.join(hits, ["ticker", "country"], "left")
        .agg(
            F.coalesce(F.sum(F.coalesce(c("hit_attempt") + 1, tried)), F.lit(0)).alias("attempted"),
            F.count("hit_attempt").alias("parsed"),
        )
        .select(F.lit(source).alias("source"), "attempted", "parsed", lookup_status().alias("status"))
    )


def lookup_status() -> Column:
    """ok only if every attempted lookup parsed, and there was one."""
    c = F.col
    return F.when((c("attempted") > 0) & (c("parsed") == c("attempted")), "ok").otherwise("warning")


def coverage_detail(label: str) -> Column:
    """Public sentence for a coverage row."""
    c = F.col
    ratio = F.concat_ws("", c("parsed"), F.lit("/"), c("attempted"), F.lit(f" {label} lookups parsed"))
    return (
        F.when(c("attempted") == 0, f"No lookups attempted for {label} fundamentals")
        .when(c("parsed") == 0, F.concat(
            F.lit(f"No successful {label} fundamentals lookups ("), ratio, F.lit(")")))
        .otherwise(ratio)
    )
