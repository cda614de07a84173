"""Listing universe from landed files: screener JSON, listing CSV, curated research JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from norrsken import constants as K
from norrsken.functions.numeric import finite, market_number
from norrsken.functions.text import clean_key, isin_country, listing_segment, non_empty, strip
from norrsken.operators.ranking import numbered
from norrsken.operators.signals import with_live_signals
from norrsken.schemas import (
    CURATED_COMPANY,
    EVIDENCE,
    METRIC_COLUMNS,
    RESEARCH,
    SCREENER_ENVELOPE,
    conform,
    null_of,
)

# --- fixed values ---------------------------------------------------------------------------
SCREENER_SOURCE = "nasdaq_nordic_screener"
DEFAULT_EXCHANGE = "Nasdaq Nordic"
LISTING_EVIDENCE_LABEL = "Nasdaq Nordic listing source"
LISTING_CHECK_NAME = "nasdaq nordic live data"


def read_screener(spark: SparkSession, path: str) -> DataFrame:
    """Landed screener envelopes, one JSON object per file, as one row per listing row.

    Broken files give one row with a non-null ``corrupt`` column, so coverage can count them.
    """
    raw = screener_envelopes(spark, path)
    return screener_rows(raw, "file").unionByName(
        # A broken file has no source either; Spark refuses to read the corrupt column alone.
        raw.where("corrupt is not null and source is null").select("file", "corrupt"),
        allowMissingColumns=True,
    )


def screener_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed file, with its path in ``file`` and a broken file's text in ``corrupt``."""
    schema = StructType([*SCREENER_ENVELOPE.fields, StructField("corrupt", StringType())])
    raw = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "corrupt")
        .json(path)
    )
    return raw.withColumn("file", F.col("_metadata.file_path"))


def parse_screener(payloads: DataFrame, text: str, order: str) -> DataFrame:
    """As ``read_screener`` for envelopes held in a text column; ``order`` is the load order."""
    parsed = payloads.select(order, F.from_json(text, SCREENER_ENVELOPE).alias("e"))
    return screener_rows(parsed.select(order, "e.*"), order)


def screener_rows(envelopes: DataFrame, order: str) -> DataFrame:
    """Envelope to rows. A bare ``data`` payload counts as one response without country."""
    bare = F.array(
        F.struct(
            F.lit("").alias("country"), F.lit(DEFAULT_EXCHANGE).alias("exchange"),
            F.lit("other_public").alias("segment"), null_of("string").alias("source_url"),
            F.struct("data").alias("payload"),
        )
    )
    responses = F.when(F.col("source") == SCREENER_SOURCE, F.col("responses")).when(
        F.col("data").isNotNull(), bare
    )
    # Plain explode: empty and null segments vanish.
    per_response = envelopes.select(order, F.posexplode(responses).alias("response", "r"))
    return per_response.select(
        order, "response", "r.country", "r.exchange", "r.segment", "r.source_url",
        F.posexplode("r.payload.data.instrumentListing.rows").alias("position", "row"),
    )


def screener_listings(rows: DataFrame, order: str) -> DataFrame:
    """Valid rows as listing plus quote columns; the first row per (ticker, country) stays."""
    c = F.col
    stated = F.upper(F.coalesce("country", F.lit("")))
    country = F.when(stated != "", stated).otherwise(
        isin_country(F.coalesce("row.isin", F.lit("")))
    )

    def cleaned(field: str) -> Column:
        return non_empty(strip(c(f"row.{field}")))

    shaped = rows.select(
        cleaned("fullName").alias("name"),
        clean_key(c("row.symbol")).alias("ticker"),
        country.alias("country"),
        F.coalesce(non_empty(c("exchange")), F.lit(DEFAULT_EXCHANGE)).alias("exchange"),
        listing_segment(c("segment")).alias("segment"),
        cleaned("sector").alias("sector"),
        cleaned("currency").alias("listing_currency"),
        market_number(c("row.lastSalePrice")).alias("price"),
        cleaned("currency").alias("price_currency"),
        market_number(c("row.percentageChange")).alias("percentage_change"),
        market_number(c("row.turnover")).alias("turnover"),
        market_number(c("row.volume")).alias("volume"),
        order, "response", "position",
    )
    return first_listing(valid_listings(shaped), [order, "response", "position"])


def valid_listings(listing: DataFrame) -> DataFrame:
    return listing.where(
        (F.col("ticker") != "")
        & (F.col("name") != "")
        & F.col("country").isin(*K.LISTING_COUNTRIES)
    )


def first_listing(listing: DataFrame, load_order: list[str]) -> DataFrame:
    """The first row per (ticker, country) in load order."""
    firsts = numbered(listing, "copy", ["ticker", "country"], [F.col(o).asc() for o in load_order])
    return firsts.where("copy = 1").drop("copy")


#: Columns of a CSV file that are read. A wider line ends the scan with an error.
CSV_WIDTH = 64
_CSV_FIELDS = ", ".join(f"c{i} string" for i in range(CSV_WIDTH + 1))


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of the listing files: the names of its file's header (trimmed, lower case) and its fields.

    A file is one row of the scan, so its header reaches its lines in the task that reads it. Listing
    files hold one market on one day. ``line`` is 0 for the header itself.
    """
    lines = F.split("value", "\r\n|\n|\r")
    # The header is taken before lines are opened: after it, the whole file would be split again for each line.
    files = spark.read.text(path, wholetext=True).select(
        F.regexp_extract("value", "^[^\\r\\n]*", 0).alias("header"), lines.alias("lines"))
    opened = files.select("header", F.posexplode("lines").alias("line", "text"))
    header = _parsed(opened.where((F.col("line") == 0) | (strip(F.col("text")) != "")), "header", "names")
    named = header.withColumn("names", F.transform("names", lambda n: F.lower(strip(n))))
    return _parsed(named, "text", "fields")


def _parsed(df: DataFrame, line: str, name: str) -> DataFrame:
    """``line`` replaced by the array of its CSV fields. The generators keep the parse from being repeated for each use."""
    others = [n for n in df.columns if n != line]
    parsed = df.select(*others, F.explode(F.array(F.from_csv(line, _CSV_FIELDS, {"escape": '"'}))).alias("_r"))
    wide = F.col(f"_r.c{CSV_WIDTH}").isNotNull()
    fields = F.array(*(F.col(f"_r.c{i}") for i in range(CSV_WIDTH)))
    checked = F.when(wide, F.raise_error(F.lit(f"more than {CSV_WIDTH} columns"))).otherwise(fields)
    return parsed.select(*others, F.explode(F.array(checked)).alias(name))


def _misses_required(names: Column) -> Column:
    def any_of(*wanted: str) -> Column:
        return F.arrays_overlap(names, F.array(*(F.lit(w) for w in wanted)))

    complete = any_of("ticker", "symbol") & any_of("name", "company") & any_of("country")
    return ~F.coalesce(complete, F.lit(False))


def read_listing_csv(spark: SparkSession, path: str) -> DataFrame:
    """Listing CSV with header synonyms. No quotes and no dedupe on this path.

    Files may have their columns in different orders, and some that others lack. One scan reads them all;
    each line's fields are looked up by its own file's header.
    """
    lines = csv_files(spark, path)
    # One row at most comes back: whether some file lacks a required column.
    if lines.where((F.col("line") == 0) & _misses_required(F.col("names"))).select("line").first():
        raise ValueError("live payload is missing required listing columns")
    fields = lines.where("line > 0")
    known = ("name", "company", "ticker", "symbol", "country", "exchange", "segment", "market", "sector", "currency")
    found = {n: F.get("fields", F.array_position("names", F.lit(n)).cast("int") - 1).alias(n) for n in known}
    return csv_listings(fields.select(*found.values()))


def csv_listings(raw: DataFrame) -> DataFrame:
    raw = raw.toDF(*(name.strip().lower() for name in raw.columns))
    have = set(raw.columns)
    if not have & {"ticker", "symbol"} or not have & {"name", "company"} or "country" not in have:
        raise ValueError("live payload is missing required listing columns")

    def either(*names: str) -> Column:
        known = [non_empty(F.col(n)) for n in names if n in have]
        return F.coalesce(*known, null_of("string"))

    listing = raw.select(
        strip(either("name", "company")).alias("name"),
        clean_key(either("ticker", "symbol")).alias("ticker"),
        clean_key(F.col("country")).alias("country"),
        strip(F.coalesce(either("exchange"), F.lit(DEFAULT_EXCHANGE))).alias("exchange"),
        listing_segment(either("segment", "market")).alias("segment"),
        either("sector").alias("sector"),
        either("currency").alias("listing_currency"),
    )
    return valid_listings(listing)


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """Curated research: one JSON array of companies per file."""
    raw = spark.read.schema(CURATED_COMPANY).option("multiLine", True).json(path)
    return curated_research(raw)


def curated_research(raw: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    no_evidence = F.array().cast(f"array<{EVIDENCE.simpleString()}>")
    # Numbers that are not finite are unknown: Spark orders NaN above every number.
    flat = raw.select(
        "*", F.col("currency").alias("listing_currency"),
        F.col("financials.currency").alias("price_currency"),
        F.col("financials.data_quality").alias("data_quality"),
        *(finite(F.col(f"financials.{n}")).alias(n) for n in ("price", *METRIC_COLUMNS)),
    ).drop("currency", "financials")
    return conform(
        flat.withColumns(
            {
                "ticker": clean_key(F.col("ticker")),
                "country": clean_key(F.col("country")),
                "catalysts": F.coalesce("catalysts", none),
                "risks": F.coalesce("risks", none),
                "evidence": F.coalesce("evidence", no_evidence),
                "data_quality": F.coalesce("data_quality", F.lit("thin")),
            }
        ),
        RESEARCH,
    )


def live_research(listing: DataFrame, quote: DataFrame, source_url: str) -> DataFrame:
    """Base research of the live universe: thin data, market signals, one evidence entry."""
    evidence = F.array(
        F.struct(
            F.lit(LISTING_EVIDENCE_LABEL).alias("label"), F.lit(source_url).alias("url"),
            F.lit("nasdaq").alias("source"), null_of("string").alias("timestamp"),
        )
    )
    df = with_live_signals(listing, quote).withColumns(
        {"data_quality": F.lit("thin"), "evidence": evidence}
    )
    return conform(df, StructType([*RESEARCH.fields, StructField("ordinal", LongType())]))


def listing_status(parsed: DataFrame, source_url: str, scanned: DataFrame | None = None) -> DataFrame:
    """One coverage row for the listing scan: error when nothing was parsed.

    ``scanned`` holds the rows of ``read_screener``; its broken files count as attempted, and make the
    status a warning.
    """
    counted = parsed.agg(F.count("*").alias("parsed"))
    if scanned is None:
        counted = counted.withColumn("broken", F.lit(0).cast("long"))
    else:
        counted = counted.withColumn("broken", scanned.agg(F.count("corrupt")).scalar())
    return _status(counted, source_url)


def _status(counted: DataFrame, source_url: str) -> DataFrame:
    n, broken = F.col("parsed"), F.col("broken")
    files = F.when(broken > 0, F.concat(F.lit(", "), broken.cast("string"), F.lit(" files unreadable"))).otherwise("")
    return counted.select(
        F.lit(LISTING_CHECK_NAME).alias("source"),
        (n + broken).alias("attempted"),
        "parsed",
        F.when(n == 0, "error").when(broken > 0, "warning").otherwise("ok").alias("status"),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(f" companies parsed from {source_url}"), files))
        .otherwise("live payload contained no SE/FI listings")
        .alias("detail"),
    )


def observed_scan(rows: DataFrame, name: str | Observation) -> DataFrame:
    """The rows of a scan with a ``corrupt`` column, counted as they pass: ``rows``, and ``broken`` among them.

    In a batch pass an ``Observation``: its counts are there after the first action over the rows. In a stream
    pass a name: every batch reports its counts under it (``observed_counts``).
    """
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), F.count("corrupt").alias("broken"))


def observed_counts(query: StreamingQuery, name: str) -> dict[str, int]:
    """Counts of ``observed_scan`` over a stream's recent batches."""
    found = [p["observedMetrics"][name] for p in query.recentProgress if name in (p["observedMetrics"] or {})]
    return {n: sum(f[n] for f in found) for n in ("rows", "broken")}


def observed_status(spark: SparkSession, parsed: int, broken: int, source_url: str) -> DataFrame:
    """``listing_status`` out of counts taken while the listing was read, without reading anything again."""
    counts = spark.range(1).select(F.lit(parsed).cast("long").alias("parsed"), F.lit(broken).cast("long").alias("broken"))
    return _status(counts, source_url)
