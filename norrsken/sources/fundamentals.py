"""Fundamentals from landed provider payloads: one JSON text per requested symbol.

Input frames have ``symbol`` (as requested), ``payload`` and ``fallback_currency``. All parsers
return the columns of ``operators.enrichment`` and drop payloads without any useful field, which
count as misses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from norrsken.functions.numeric import as_percent, eur_rate, number, payload_number, round_dp
from norrsken.functions.text import clean_text
from norrsken.operators.enrichment import FUNDAMENTAL_COLUMNS, MEANINGFUL_COLUMNS
from norrsken.schemas import null_of

# --- fixed values: evidence labels and links ------------------------------------------------
QUOTE_SUMMARY_URL = (
    "https://query1.finance.yahoo.com/v10/finance/quoteSummary/",
    "?modules=price,summaryDetail,financialData",
)
METRICS_DOC_URL = "https://finnhub.io/docs/api/company-profile2"
SEARCH_DOC_URL = "https://developers.finimpulse.com/v1/search/"
SOURCE_LABELS = {"yahoo": "Yahoo-style", "finnhub": "Finnhub", "finimpulse": "Finimpulse"}
SOURCE_CHECK_NAMES = {
    "yahoo": "free fundamentals",
    "finnhub": "finnhub fundamentals",
    "finimpulse": "finimpulse fundamentals",
}


def _rate(currency: Column) -> Column:
    stated = F.when(currency != "", currency)
    return eur_rate(F.coalesce(stated, F.col("fallback_currency"), F.lit("")))


def _snapshot(values: DataFrame, source: str, url: Column, **rounding) -> DataFrame:
    """Fundamentals rows from unrounded values; rows without any value are dropped before rounding.

    ``values`` has symbol and some of the fundamentals columns. ``rounding`` maps columns to
    functions that keep nulls.
    """
    label = F.concat(F.lit(f"{SOURCE_LABELS[source]} fundamentals lookup ("), F.col("symbol"), F.lit(")"))
    evidence = F.struct(
        label.alias("label"), url.alias("url"), F.lit(source).alias("source"),
        null_of("string").alias("timestamp"),
    )
    have = set(values.columns)
    known = [F.col(n) for n in MEANINGFUL_COLUMNS if n in have]
    columns = []
    for name in FUNDAMENTAL_COLUMNS:
        kind = "string" if name in ("business_description", "ir_url") else "double"
        value = F.col(name) if name in have else null_of(kind)
        columns.append(rounding[name](value).alias(name) if name in rounding else value.alias(name))
    return values.where(F.coalesce(*known).isNotNull()).select(
        "symbol", *columns, evidence.alias("evidence_item")
    )


def _two(x: Column) -> Column:
    return round_dp(x, 2)


def _four(x: Column) -> Column:
    return round_dp(x, 4)


def _texts(*names: str) -> StructType:
    """Payload fields read as text: a value may be a number, a text or an object."""
    return StructType([StructField(name, StringType()) for name in names])


_QUOTE_SUMMARY = StructType(
    [
        StructField("price", _texts("currency", "marketCap")),
        StructField(
            "summaryDetail",
            _texts("trailingPE", "priceToBook", "averageDailyVolume10Day", "previousClose"),
        ),
        StructField(
            "financialData",
            _texts("revenueGrowth", "operatingMargins", "debtToEquity", "totalCash", "totalDebt"),
        ),
    ]
)
_QUOTE_SUMMARY_PAYLOAD = StructType(
    [StructField("quoteSummary", StructType([StructField("result", ArrayType(_QUOTE_SUMMARY))]))]
)


def parse_quote_summary(payloads: DataFrame) -> DataFrame:
    """Quote-summary payload.

    The first result is taken by an explode, so that every text is parsed exactly once and later
    filters cannot pull the parsing into their conditions.
    """
    results = F.from_json("payload", _QUOTE_SUMMARY_PAYLOAD)["quoteSummary"]["result"]
    first = payloads.select(
        "symbol", "fallback_currency", F.explode(F.slice(results, 1, 1)).alias("r")
    )
    r, rate = F.col("r"), F.col("rate")

    def raw(section: str, key: str) -> Column:
        return payload_number(r[section][key])

    values = first.withColumn("rate", _rate(r["price"]["currency"])).select(
        "symbol",
        (raw("price", "marketCap") * rate / 1_000_000.0).alias("market_cap_eur_m"),
        raw("summaryDetail", "trailingPE").alias("pe_ratio"),
        raw("summaryDetail", "priceToBook").alias("price_to_book"),
        (raw("financialData", "revenueGrowth") * 100.0).alias("revenue_growth_pct"),
        (raw("financialData", "operatingMargins") * 100.0).alias("operating_margin_pct"),
        (raw("financialData", "debtToEquity") / 100.0).alias("debt_to_equity"),
        (
            (raw("financialData", "totalCash") - raw("financialData", "totalDebt"))
            * rate / 1_000_000.0
        ).alias("net_cash_eur_m"),
        (
            raw("summaryDetail", "averageDailyVolume10Day")
            * raw("summaryDetail", "previousClose") * rate
        ).alias("average_daily_value_eur"),
    )
    return _snapshot(
        values,
        "yahoo",
        F.concat(F.lit(QUOTE_SUMMARY_URL[0]), F.url_encode("symbol"), F.lit(QUOTE_SUMMARY_URL[1])),
        market_cap_eur_m=_two,
        revenue_growth_pct=_two,
        operating_margin_pct=_two,
        debt_to_equity=_four,
        net_cash_eur_m=_two,
    )


_METRIC_ALTERNATIVES = {
    "pe": ("peBasicExclExtraTTM", "peNormalizedAnnual"),
    "pb": ("pbQuarterly", "pbAnnual"),
    "growth": ("revenueGrowthTTMYoy", "revenueGrowthQuarterlyYoy"),
    "margin": ("operatingMarginTTM", "operatingMarginAnnual"),
    "debt_pct": ("totalDebt/totalEquityQuarterly", "totalDebt/totalEquityAnnual"),
}
_METRICS_PAYLOAD = StructType(
    [
        StructField("profile", _texts("currency", "marketCapitalization")),
        StructField(
            "metrics",
            StructType(
                [
                    StructField(
                        "metric", _texts(*(k for keys in _METRIC_ALTERNATIVES.values() for k in keys))
                    )
                ]
            ),
        ),
    ]
)


def parse_profile_metrics(payloads: DataFrame) -> DataFrame:
    """Profile and metrics payload; of alternative keys the first number counts."""
    parsed = payloads.select(
        "symbol", "fallback_currency",
        F.explode(F.array(F.from_json("payload", _METRICS_PAYLOAD))).alias("r"),
    )
    r = F.col("r")

    def metric(name: str) -> Column:
        keys = _METRIC_ALTERNATIVES[name]
        return F.coalesce(*(number(r["metrics"]["metric"][k]) for k in keys))

    cap = number(r["profile"]["marketCapitalization"]) * _rate(r["profile"]["currency"])
    values = parsed.select(
        "symbol",
        cap.alias("market_cap_eur_m"),
        metric("pe").alias("pe_ratio"),
        metric("pb").alias("price_to_book"),
        metric("growth").alias("revenue_growth_pct"),
        metric("margin").alias("operating_margin_pct"),
        (metric("debt_pct") / 100.0).alias("debt_to_equity"),
    )
    return _snapshot(
        values, "finnhub", F.lit(METRICS_DOC_URL), market_cap_eur_m=_two, debt_to_equity=_four
    )


_SEARCH_KEYS = (
    "currency", "regular_market_price", "amount", "average_daily_volume_10_day",
    "revenue_growth", "net_margin", "free_cash_flow_margin", "debt_to_equity",
    "one_year_return", "fifty_two_week_high_change_percent",
)


def _matching_item(payloads: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first item of a search result whose symbol is the requested one."""
    items = StructType([StructField("items", ArrayType(_texts("symbol", *keys)))])
    result = F.from_json("payload", StructType([StructField("result", items)]))
    own = F.filter(
        result["result"]["items"], lambda x: F.upper(x["symbol"]) == F.upper(F.col("symbol"))
    )
    return payloads.select(
        "symbol", "fallback_currency", F.explode(F.slice(own, 1, 1)).alias("item")
    )


def parse_search(payloads: DataFrame) -> DataFrame:
    df = _matching_item(payloads, _SEARCH_KEYS)
    item, rate = F.col("item"), F.col("rate")
    values = df.withColumn("rate", _rate(item["currency"])).select(
        item["symbol"].alias("symbol"),
        (number(item["amount"]) * rate / 1_000_000.0).alias("market_cap_eur_m"),
        as_percent(number(item["revenue_growth"])).alias("revenue_growth_pct"),
        as_percent(
            F.coalesce(number(item["net_margin"]), number(item["free_cash_flow_margin"]))
        ).alias("operating_margin_pct"),
        number(item["debt_to_equity"]).alias("debt_to_equity"),
        number(item["one_year_return"]).alias("one_year_return_pct"),
        number(item["fifty_two_week_high_change_percent"]).alias("distance_from_52w_high_pct"),
        (
            number(item["regular_market_price"]) * number(item["average_daily_volume_10_day"]) * rate
        ).alias("average_daily_value_eur"),
    )
    return _snapshot(
        values,
        "finimpulse",
        F.lit(SEARCH_DOC_URL),
        market_cap_eur_m=_two,
        revenue_growth_pct=_two,
        operating_margin_pct=_two,
        average_daily_value_eur=_two,
    )


def parse_profile_text(payloads: DataFrame) -> DataFrame:
    """Description and investor-relations link; nothing when both are empty."""
    df = _matching_item(payloads, ("long_business_summary", "ir_website"))
    item = F.col("item")
    return df.select(
        "symbol",
        clean_text(item["long_business_summary"]).alias("business_description"),
        clean_text(item["ir_website"]).alias("ir_url"),
    ).where(F.coalesce("business_description", "ir_url").isNotNull())
