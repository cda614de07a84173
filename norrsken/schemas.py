"""Schemas of the domain tables and landing files. Sources never infer a schema."""

from __future__ import annotations

from pyspark.sql import Column, functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    MapType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


TEXTS = ArrayType(StringType())
EVIDENCE = _struct(
    label=StringType(), url=StringType(), source=StringType(), timestamp=StringType()
)

COMPANY_COLUMNS = (
    "name", "ticker", "country", "exchange", "segment", "sector", "market_cap_eur_m",
    "listing_currency", "ir_url", "business_description",
)
METRIC_COLUMNS = (
    "pe_ratio", "price_to_book", "ev_to_ebit", "revenue_eur_m", "book_value_eur_m",
    "net_income_eur_m", "net_cash_eur_m", "debt_to_equity", "revenue_growth_pct",
    "operating_margin_pct", "one_year_return_pct", "distance_from_52w_high_pct",
    "average_daily_value_eur",
)
# Filled from fundamentals when the base row has none; price context is never filled.
FILLABLE_METRICS = tuple(
    name for name in METRIC_COLUMNS
    if name not in ("one_year_return_pct", "distance_from_52w_high_pct")
)
SCORE_COLUMNS = (
    "value", "discovery", "catalyst", "risk_penalty", "data_quality_penalty", "total",
    "reasons", "warnings",
)

RESEARCH = StructType(
    [
        *(
            StructField(name, DoubleType() if name == "market_cap_eur_m" else StringType())
            for name in COMPANY_COLUMNS
        ),
        StructField("price", DoubleType()),
        StructField("price_currency", StringType()),
        *(StructField(name, DoubleType()) for name in METRIC_COLUMNS),
        StructField("catalysts", TEXTS),
        StructField("risks", TEXTS),
        StructField("evidence", ArrayType(EVIDENCE)),
        StructField("data_quality", StringType()),
    ]
)

# Landing files -----------------------------------------------------------------------------
SCREENER_ROW = _struct(
    fullName=StringType(), symbol=StringType(), currency=StringType(),
    lastSalePrice=StringType(), percentageChange=StringType(), turnover=StringType(),
    volume=StringType(), sector=StringType(), isin=StringType(),
)
SCREENER_DATA = _struct(instrumentListing=_struct(rows=ArrayType(SCREENER_ROW)))
SCREENER_ENVELOPE = _struct(
    source=StringType(),
    responses=ArrayType(
        _struct(
            country=StringType(), exchange=StringType(), segment=StringType(),
            source_url=StringType(), payload=_struct(data=SCREENER_DATA),
        )
    ),
    data=SCREENER_DATA,
)
CURATED_FINANCIALS = StructType(
    [
        StructField("price", DoubleType()),
        StructField("currency", StringType()),
        *(StructField(name, DoubleType()) for name in METRIC_COLUMNS),
        StructField("data_quality", StringType()),
    ]
)
CURATED_COMPANY = _struct(
    name=StringType(), ticker=StringType(), country=StringType(), exchange=StringType(),
    segment=StringType(), sector=StringType(), market_cap_eur_m=DoubleType(),
    currency=StringType(), ir_url=StringType(), financials=CURATED_FINANCIALS,
    catalysts=TEXTS, risks=TEXTS, evidence=ArrayType(EVIDENCE),
)

VALUATION = _struct(
    has_support=BooleanType(), is_attractive=BooleanType(), primary_kind=StringType(),
    primary_value=DoubleType(), summary=StringType(),
)
GATE = _struct(
    tier=StringType(), reasons=TEXTS, blockers=TEXTS, durable_anchor_count=IntegerType(),
    severe_proof_gap_count=IntegerType(), valuation=VALUATION,
)
CONVICTION = _struct(
    bucket=StringType(), thesis=StringType(),
    components=MapType(StringType(), _struct(score=IntegerType(), view=StringType())),
)
REPORT = _struct(
    metadata=_struct(generated_at=StringType(), strategy=StringType()),
    items=ArrayType(
        _struct(
            rank=IntegerType(),
            company=_struct(
                ticker=StringType(), name=StringType(), country=StringType(),
                exchange=StringType(), segment=StringType(), sector=StringType(),
            ),
            financials=_struct(price=DoubleType(), currency=StringType()),
            score=_struct(total=DoubleType(), reasons=TEXTS, warnings=TEXTS),
            risks=TEXTS,
            data_quality=StringType(),
            long_term_conviction=CONVICTION,
            long_term_gate=GATE,
        )
    ),
)

# Ledger tables -----------------------------------------------------------------------------
PICKS = StructType(
    [
        StructField("pick_id", StringType()),
        StructField("report_date", DateType()),
        StructField("strategy", StringType()),
        StructField("rank", IntegerType()),
        StructField("ticker", StringType()),
        StructField("name", StringType()),
        StructField("country", StringType()),
        StructField("exchange", StringType()),
        StructField("segment", StringType()),
        StructField("sector", StringType()),
        StructField("report_url", StringType()),
        StructField("entry_price", DoubleType()),
        StructField("entry_currency", StringType()),
        StructField("entry_timestamp", StringType()),
        StructField("score_total", DoubleType()),
        StructField("reasons", TEXTS),
        StructField("warnings", TEXTS),
        StructField("risks", TEXTS),
        StructField("data_quality", StringType()),
        StructField("long_term_conviction", CONVICTION),
        StructField("long_term_gate", GATE),
    ]
)
OUTCOMES = StructType(
    [
        StructField("pick_id", StringType()),
        StructField("report_date", DateType()),
        StructField("horizon", StringType()),
        StructField("due_date", DateType()),
        StructField("as_of_date", DateType()),
        StructField("price", DoubleType()),
        StructField("currency", StringType()),
        StructField("return_pct", DoubleType()),
        StructField("status", StringType()),
        StructField("benchmark_label", StringType()),
        StructField("benchmark_return_pct", DoubleType()),
        StructField("excess_return_pct", DoubleType()),
    ]
)
SNAPSHOTS = StructType(
    [
        StructField("snapshot_date", DateType()),
        StructField("ticker", StringType()),
        StructField("country", StringType()),
        StructField("price", DoubleType()),
        StructField("currency", StringType()),
        StructField("name", StringType()),
        StructField("segment", StringType()),
        StructField("sector", StringType()),
        StructField("catalysts", TEXTS),
        StructField("risks", TEXTS),
    ]
)


def null_of(kind) -> Column:
    return F.lit(None).cast(kind)


def conform(df, schema: StructType):
    """Select the schema's columns in order; columns the frame lacks become nulls."""
    have = set(df.columns)
    return df.select(
        *(
            (F.col(f.name) if f.name in have else null_of(f.dataType)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        )
    )
