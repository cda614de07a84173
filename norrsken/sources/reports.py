"""Watchlist reports: nested JSON out, pick rows in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from norrsken import constants as K
from norrsken.functions.numeric import finite
from norrsken.functions.text import strip
from norrsken.operators.outcomes import pick_id
from norrsken.operators.presentation import with_presentation
from norrsken.operators.ranking import numbered
from norrsken.schemas import COMPANY_COLUMNS, METRIC_COLUMNS, PICKS, REPORT, SCORE_COLUMNS, conform


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files. The file path gives the load order; see ``report_rows``."""
    files = spark.read.text(path, wholetext=True)
    return report_rows(files.withColumn("load_order", F.col("_metadata.file_path")))


def report_rows(files: DataFrame) -> DataFrame:
    """Whole files (``value``) as reports: one document on any number of lines, or one on each line.

    A file whose first line is a document by itself has one on each line. A broken document gives a row
    without items and its text in ``corrupt``.
    """
    schema = StructType([*REPORT.fields, StructField("corrupt", StringType())])
    by_line = F.try_parse_json(F.substring_index("value", "\n", 1)).isNotNull()
    lines = F.filter(F.split("value", "\n"), lambda line: F.trim(line) != "")
    others = [n for n in files.columns if n != "value"]
    documents = files.select(
        *others, F.explode(F.when(by_line, lines).otherwise(F.array("value"))).alias("document")
    )
    parsed = F.from_json("document", schema, {"columnNameOfCorruptRecord": "corrupt"})
    return documents.select(*others, parsed.alias("r")).select(*others, "r.*")


def report_picks(
    reports: DataFrame, report_date: Column, report_url: Column | None = None,
    load_order: str = "load_order",
) -> DataFrame:
    """Report items as pick rows. Only the two tracked strategies make picks.

    If the same pick occurs again in the batch, the later occurrence wins.
    """
    c = F.col
    strategy = strip(F.coalesce("metadata.strategy", F.lit("")))
    base = reports.select(
        strategy.alias("strategy"),
        report_date.cast("date").alias("report_date"),
        c("metadata.generated_at").alias("entry_timestamp"),
        c(load_order).alias("load_order"),
        F.posexplode("items").alias("position", "item"),
    ).where(c("strategy").isin(*K.TRACKED_STRATEGIES))
    default_url = F.concat(
        F.lit("../reports/"), c("strategy"), F.lit("/"), c("report_date").cast("string"),
        F.lit(".html"),
    )
    none = F.array().cast("array<string>")
    item = c("item")
    picks = base.select(
        "strategy", "report_date", "entry_timestamp", "load_order", "position",
        item["rank"].alias("rank"),
        F.upper(item["company"]["ticker"]).alias("ticker"),
        F.upper(F.coalesce(item["company"]["country"], F.lit(""))).alias("country"),
        *(item["company"][n].alias(n) for n in ("name", "exchange", "segment", "sector")),
        item["financials"]["price"].alias("entry_price"),
        item["financials"]["currency"].alias("entry_currency"),
        item["score"]["total"].alias("score_total"),
        F.coalesce(item["score"]["reasons"], none).alias("reasons"),
        F.coalesce(item["score"]["warnings"], none).alias("warnings"),
        F.coalesce(item["risks"], none).alias("risks"),
        *(item[n].alias(n) for n in ("data_quality", "long_term_conviction", "long_term_gate")),
    ).withColumns(
        {
            "pick_id": pick_id(c("report_date"), c("strategy"), c("country"), c("ticker")),
            "report_url": report_url if report_url is not None else default_url,
        }
    )
    last = numbered(picks, "copy", ["pick_id"], [c("load_order").desc(), c("position").desc()])
    return conform(last.where("copy = 1"), PICKS)


def unknown_strategies(reports: DataFrame) -> DataFrame:
    """Reports whose strategy makes no picks; callers treat a row here as an error."""
    strategy = strip(F.coalesce("metadata.strategy", F.lit("")))
    return reports.where(~strategy.isin(*K.TRACKED_STRATEGIES)).select(strategy.alias("strategy"))


def rejected_reports(reports: DataFrame, load_order: str = "load_order") -> DataFrame:
    """load_order, strategy and reason of report files that make no picks."""
    strategy = strip(F.coalesce("metadata.strategy", F.lit("")))
    broken = F.col("corrupt").isNotNull()
    reason = F.when(broken, F.lit("unreadable file")).otherwise("strategy without picks")
    return reports.where(broken | ~strategy.isin(*K.TRACKED_STRATEGIES)).select(
        F.col(load_order).alias("load_order"), strategy.alias("strategy"), reason.alias("reason")
    )


def company_struct() -> Column:
    renamed = [
        F.col(n).alias("currency" if n == "listing_currency" else n) for n in COMPANY_COLUMNS
    ]
    renamed[COMPANY_COLUMNS.index("market_cap_eur_m")] = finite(F.col("market_cap_eur_m")).alias(
        "market_cap_eur_m"
    )
    return F.struct(*renamed)


def financials_struct() -> Column:
    return F.struct(
        finite(F.col("price")).alias("price"),
        F.col("price_currency").alias("currency"),
        *(finite(F.col(n)).alias(n) for n in METRIC_COLUMNS),
        "data_quality",
    )


def report_items(ranked: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """Ranked ideas as report items, one row per item, with run and strategy for partitioning.

    Long-term rows carry conviction and gate when ``with_report_columns`` added them.
    """
    columns = [
        *run, "strategy", "rank",
        company_struct().alias("company"),
        "company_presentation",
        financials_struct().alias("financials"),
        F.struct(*SCORE_COLUMNS).alias("score"),
        "risks", "catalysts", "evidence", "data_quality",
    ]
    if "conviction" in ranked.columns:
        columns += [
            F.col("conviction").alias("long_term_conviction"),
            F.col("gate")
            .withField("valuation.primary_value", finite(F.col("gate.valuation.primary_value")))
            .alias("long_term_gate"),
        ]
    return with_presentation(ranked).select(*columns)


def report_documents(
    items: DataFrame, metadata: Column, checks: DataFrame, run: Sequence[str] = ()
) -> DataFrame:
    """One report document per run and strategy, in the shape ``read_reports`` reads.

    A report holds one top-k list, so the collected items are bounded by the limit; the source
    checks are one row per source. ``run`` names the columns that tell runs apart, for example a date.
    """
    entries = [n for n in items.columns if n != "strategy" and n not in run]
    listed = items.groupBy(*run, "strategy").agg(
        F.array_sort(
            F.collect_list(F.struct(*entries)), lambda a, b: a["rank"] - b["rank"]
        ).alias("items")
    )
    detail = checks.agg(
        F.collect_list(
            F.struct(F.col("source").alias("name"), "status", "detail")
        ).alias("source_checks")
    )
    with_checks = listed.withColumn("source_checks", detail.scalar())
    return with_checks.select(
        *run, "strategy", F.lit(K.DISCLAIMER).alias("disclaimer"), metadata.alias("metadata"),
        "source_checks", "items",
    )


def write_reports(documents: DataFrame, path: str, run: Sequence[str] = ()) -> None:
    """One JSON document per run and strategy, in folders named by them."""
    documents.write.mode("overwrite").partitionBy(*run, "strategy").option(
        "ignoreNullFields", False
    ).json(path)


def profile_documents(profiles: DataFrame) -> DataFrame:
    """Company profiles as nested documents."""
    return profiles.select(
        F.lit(K.DISCLAIMER).alias("disclaimer"),
        company_struct().alias("company"),
        financials_struct().alias("financials"),
        F.struct(*SCORE_COLUMNS).alias("score"),
        "business_summary", "why_it_appeared", "valuation_view", "catalysts", "risks",
        "bull_case", "base_case", "bear_case", "next_manual_checks", "evidence", "data_quality",
    )


def write_profiles(profiles: DataFrame, path: str) -> None:
    profile_documents(profiles).write.mode("overwrite").option("ignoreNullFields", False).json(path)
