"""The registered queries: every operator over the whole test tables.

Dates and text lists are shown as text, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from norrsken import constants as K
from norrsken.functions import text as T
from norrsken.functions.dates import add_weekdays, iso_date
from norrsken.operators import calendar as cal
from norrsken.operators import enrichment as en
from norrsken.operators import outcomes as oc
from norrsken.operators import quality as ql
from norrsken.operators import ranking as rk
from norrsken.operators import scorecard as sc
from norrsken.operators import scoring as so
from norrsken.operators import signals as sg
from norrsken.operators.conviction import COMPONENTS, with_components
from norrsken.plans.profile import company_profiles
from norrsken.plans.summary import ledger_summary as summary_frames
from norrsken.plans.summary import write_summary
from norrsken.plans.watchlist import (
    enrichment_candidates,
    scored_ideas,
    watchlist,
    with_report_columns,
)
from norrsken.schemas import METRIC_COLUMNS, REPORT
from norrsken.session import checkpointed, shared_folder
from norrsken.sources import fundamentals as fu
from norrsken.sources import listings as ls
from norrsken.sources import reports as rp
from norrsken.sources import testtables as tt
from norrsken.sources.ledger import Ledger, merge_picks
from norrsken.streaming.ledger_updates import report_stream, stream_ledger_update
from norrsken.streaming.market_context import read_context, start_context_sink, stream_market_context

Query = Callable[[SparkSession, str], DataFrame]
c = F.col


def shown(items: str) -> Column:
    return F.array_join(F.coalesce(items, F.array().cast("array<string>")), " | ").alias(items)


def as_text(day: str) -> Column:
    return c(day).cast("string").alias(day)


def score_columns() -> list:
    return [
        "strategy", "ticker", "country", "value", "discovery", "catalyst", "risk_penalty",
        "data_quality_penalty", "total", shown("reasons"), shown("warnings"),
    ]


# Signals and scores ------------------------------------------------------------------------------


def live_signals(spark, sf):
    df = sg.with_live_signals(tt.listing(spark, sf), tt.listed_quote(spark, sf))
    return df.select("ticker", "country", shown("catalysts"), shown("risks"))


def base_score(spark, sf):
    df = so.with_base_score(tt.research(spark, sf))
    return df.select(*score_columns()[1:])


def strategy_scores(spark, sf):
    return so.strategy_scores(tt.research(spark, sf)).select(*score_columns())


def trading_setups(spark, sf):
    df = tt.research(spark, sf)
    return df.select(
        "ticker", "country",
        sg.has_trading_setup(c("catalysts")).alias("has_setup"),
        F.size(F.filter("catalysts", sg.is_material_event)).cast("long").alias("events"),
        F.size(F.filter("catalysts", sg.is_trading_only)).cast("long").alias("trading_only"),
        F.size(F.filter("catalysts", sg.is_trading_relevant)).cast("long").alias("relevant"),
    )


# Watchlists --------------------------------------------------------------------------------------


def _list(strategy: str, **options) -> Query:
    def query(spark, sf):
        ranked = watchlist(tt.research(spark, sf), strategy, **options)
        extra = [c("gate.tier").alias("tier")] if strategy == "long-term" else []
        return ranked.select(*score_columns(), *extra, c("rank").cast("long").alias("rank"))

    return query


FILTERS = dict(
    countries=["se"], include_first_north=False, min_market_cap=60.0, max_market_cap=900.0,
    sector=" Machinery ",
)
QUOTA = {"fi": 16, "SE": 3}
WIDE_QUOTA = {"FI": 8, "SE": 6}


def all_watchlists(spark, sf):
    ranked = watchlist(tt.research(spark, sf), K.STRATEGIES, min_country_counts={"SE": 12})
    return ranked.select("strategy", "ticker", "country", "total", c("rank").cast("long").alias("rank"))


def long_list(spark, sf):
    """Lists beyond what Spark limits before a shuffle, with a quota."""
    ranked = watchlist(tt.research(spark, sf), ["balanced", "long-term"], limit=1200, min_country_counts={"FI": 700})
    return ranked.select("strategy", "ticker", "country", "total", c("rank").cast("long").alias("rank"))


def watchlist_enriched(spark, sf):
    ranked = watchlist(
        tt.research(spark, sf, known_metrics=False),
        ["balanced", "long-term"], limit=20, min_country_counts={"FI": 12},
        fundamentals=fu.parse_quote_summary(tt.quote_summary_payloads(spark, sf)),
        enrichment_budget=15,
    )
    return ranked.select(
        *score_columns(), "data_quality", F.size("evidence").cast("long").alias("n_evidence"),
        c("rank").cast("long").alias("rank"),
    )


def enrichment_budget(spark, sf):
    scored = scored_ideas(tt.research(spark, sf), ["balanced", "long-term", "trading"])
    chosen = enrichment_candidates(scored, 20, 12, {"FI": 12})
    return chosen.select("strategy", "ticker", "country", "total", c("rank").cast("long").alias("rank"))


def dedupe_companies(spark, sf):
    scored = so.strategy_scores(tt.research(spark, sf), "balanced")
    best = rk.best_per_company(scored)
    return best.select("company_key", "ticker", "country", "total")


# Long-term quality -------------------------------------------------------------------------------


def valuation_support(spark, sf):
    df = ql.with_valuation(tt.research(spark, sf))
    v = "valuation"
    return df.select(
        "ticker", "country",
        *(c(f"{v}.{n}").alias(n) for n in ("has_support", "is_attractive", "primary_kind", "primary_value")),
        c(f"{v}.summary").alias("valuation_summary"),
    )


def quality_assessment(spark, sf):
    df = ql.with_thesis(ql.with_quality(tt.research(spark, sf)))
    return df.select(
        "ticker", "country", "quality_adjustment", "proof_penalty", "bucket",
        shown("quality_reasons"), shown("proof_gaps"), "thesis",
    )


def longterm_gate(spark, sf):
    df = ql.with_gate(ql.with_quality(tt.research(spark, sf)))
    return df.select(
        "ticker", "country", c("gate.tier").alias("tier"),
        F.array_join("gate.reasons", " | ").alias("gate_reasons"),
        F.array_join("gate.blockers", " | ").alias("blockers"),
        c("gate.durable_anchor_count").cast("long").alias("anchors"),
        c("gate.severe_proof_gap_count").cast("long").alias("severe_gaps"),
    )


def gate_tier_counts(spark, sf):
    gated = ql.with_gate(ql.with_quality(tt.research(spark, sf)))
    return ql.tier_counts(gated, "sector").select(
        "sector", "tier", "companies", "no_high_conviction"
    )


def conviction_components(spark, sf):
    scored = so.strategy_scores(tt.research(spark, sf), "long-term")
    df = with_components(scored)
    names = [name.lower().replace(" ", "_") for name in COMPONENTS]
    return df.select(
        "ticker", "country",
        *(F.get("components", i)["score"].cast("long").alias(f"{n}_score") for i, n in enumerate(names)),
        *(F.get("components", i)["view"].alias(f"{n}_view") for i, n in enumerate(names)),
    )


# Fundamentals ------------------------------------------------------------------------------------

_FUNDAMENTALS = (
    "symbol", "market_cap_eur_m", "pe_ratio", "price_to_book", "net_cash_eur_m",
    "debt_to_equity", "revenue_growth_pct", "operating_margin_pct", "average_daily_value_eur",
    "one_year_return_pct", "distance_from_52w_high_pct",
)


def payload_quote_summary(spark, sf):
    df = fu.parse_quote_summary(tt.quote_summary_payloads(spark, sf))
    return df.select(*_FUNDAMENTALS, c("evidence_item.label").alias("label"))


def payload_profile_metrics(spark, sf):
    df = fu.parse_profile_metrics(tt.profile_metrics_payloads(spark, sf))
    return df.select(*_FUNDAMENTALS, c("evidence_item.label").alias("label"))


def payload_search(spark, sf):
    hits = fu.parse_search(tt.search_payloads(spark, sf))
    profiles = fu.parse_profile_text(tt.profile_text_payloads(spark, sf))
    df = en.with_profile_text(hits, profiles)
    return df.select(*_FUNDAMENTALS, "business_description", "ir_url")


def symbol_candidates(spark, sf):
    df = en.with_candidates(tt.listing(spark, sf).select("ticker", "country"))
    return df.select("ticker", "country", c("attempt").cast("long").alias("attempt"), "symbol")


def first_hit_fundamentals(spark, sf):
    hits = en.first_hits(
        tt.listing(spark, sf), fu.parse_quote_summary(tt.quote_summary_payloads(spark, sf))
    )
    return hits.select(
        "ticker", "country", c("hit_attempt").cast("long").alias("hit_attempt"), *_FUNDAMENTALS
    )


def fundamentals_merge(spark, sf):
    base = tt.research(spark, sf, known_metrics=False)
    hits = en.first_hits(
        base.select("ticker", "country"),
        fu.parse_quote_summary(tt.quote_summary_payloads(spark, sf)),
    )
    df = en.merge_fundamentals(base, hits)
    return df.select(
        "ticker", "country", "market_cap_eur_m", *METRIC_COLUMNS, "data_quality",
        F.size("evidence").cast("long").alias("n_evidence"),
    )


def _landed_screener(spark, sf):
    """The listing as landed screener files, one envelope each, and a broken one among them."""
    folder = f"{shared_folder(spark, 'screener')}/files"
    tt.screener_payloads(spark, sf).write.partitionBy("load_order").text(folder)
    broken = spark.createDataFrame([("{ broken",)], "payload string")
    broken.write.text(f"{folder}/load_order=~broken")
    return folder


def source_coverage(spark, sf):
    """Three lookup sources, and the listing scan counted while its files are read."""
    companies = tt.listing(spark, sf).select("ticker", "country")
    sources = {
        "yahoo": fu.parse_quote_summary(tt.quote_summary_payloads(spark, sf)),
        "finnhub": fu.parse_profile_metrics(tt.profile_metrics_payloads(spark, sf)),
        "finimpulse": fu.parse_search(tt.search_payloads(spark, sf)),
    }
    rows = None
    for name, parsed in sources.items():
        one = en.coverage(companies, parsed, fu.SOURCE_CHECK_NAMES[name]).withColumn(
            "detail", en.coverage_detail(fu.SOURCE_LABELS[name])
        )
        rows = one if rows is None else rows.unionByName(one)
    seen = Observation("screener")
    scanned = ls.observed_scan(ls.read_screener(spark, _landed_screener(spark, sf)), seen)
    # The listing is written once, as a run does; the counts of its files come with it.
    parsed = checkpointed(ls.screener_listings(scanned, "file")).count()
    scan = ls.observed_status(spark, parsed, seen.get["broken"], "file:customer")
    return rows.unionByName(scan).select(
        "source", c("attempted").cast("long").alias("attempted"),
        c("parsed").cast("long").alias("parsed"), "status", "detail",
    )


# Ledger and outcomes -----------------------------------------------------------------------------


def _evaluated(spark, sf):
    return oc.evaluate_history(
        tt.picks(spark, sf), tt.daily_quotes(spark, sf), tt.snapshots(spark, sf),
        tt.run_dates(spark, sf),
    )


def due_dates(spark, sf):
    df = oc.with_horizons(tt.picks(spark, sf))
    return df.select("pick_id", "horizon", as_text("due_date"))


def weekday_spine(spark, sf):
    days = cal.day_spine(tt.table(spark, sf, "orders"), "o_orderdate", "o_orderdate")
    steps = F.explode(F.array(*(F.lit(n) for n in K.HORIZONS.values())))
    df = days.select("day", steps.alias("n"))
    return df.select(
        as_text("day"), c("n").cast("long").alias("n"),
        add_weekdays(c("day"), c("n")).cast("string").alias("due"),
    )


def outcomes(spark, sf):
    return _evaluated(spark, sf).select(
        "pick_id", "horizon", as_text("due_date"), as_text("as_of_date"), "status", "price",
        "currency", "return_pct", "benchmark_label", "benchmark_return_pct", "excess_return_pct",
    )


def country_benchmark(spark, sf):
    spans = oc.with_horizons(tt.picks(spark, sf))
    df = oc.country_benchmark(tt.snapshots(spark, sf), spans)
    return df.select(
        "country", as_text("report_date"), as_text("due_date"), "peers", "benchmark_return_pct"
    )


def ledger_upsert(spark, sf):
    picks = tt.picks(spark, sf)
    last_day = picks.agg(F.max("report_date")).scalar()
    existing = picks.where(c("report_date") < last_day)
    incoming = picks.where("strategy = 'long-term'").withColumns(
        {
            "entry_price": c("entry_price") + 1.0,
            "entry_timestamp": F.lit("later"),
            "score_total": c("score_total") + 5.0,
        }
    )
    priced = _evaluated(spark, sf).where(c("status") == K.PRICED).select("report_date", "pick_id")
    df = merge_picks(existing, incoming, priced)
    return df.select("pick_id", "entry_price", "entry_timestamp", "score_total")


def horizon_scorecard(spark, sf):
    df = sc.horizon_scorecard(_evaluated(spark, sf))
    return df.select(
        *(
            c(n).cast("long").alias(n) if n in ("completed", "large_loser_count", "horizon_days") else c(n)
            for n in df.columns
        )
    )


def signal_attribution(spark, sf):
    return sc.signal_attribution(tt.picks(spark, sf), _evaluated(spark, sf))


def top_signals(spark, sf):
    df = sc.top_signals(signal_attribution(spark, sf))
    return df.select(
        "scope", "signal", T.signal_label(c("signal")).alias("label"),
        c("rank").cast("long").alias("rank"),
    )


def learning_suggestions(spark, sf):
    df = sc.learning_suggestions(signal_attribution(spark, sf))
    return df.select("scope", c("rank").cast("long").alias("rank"), "suggestion")


_PICK_LINE = ("scope", "pick_id", "name", "ticker", "strategy", "horizon", "return_pct", "report_url")


def best_picks(spark, sf):
    df = sc.best_picks(_evaluated(spark, sf))
    return df.select(*_PICK_LINE, c("rank").cast("long").alias("rank"))


def worst_picks(spark, sf):
    rows = _evaluated(spark, sf)
    df = sc.worst_not_best(sc.worst_picks(rows), sc.best_picks(rows))
    return df.select(*_PICK_LINE, c("rank").cast("long").alias("rank"))


def _context(df):
    counts = ("companies", "positive_movers", "selloffs", "active_turnover")
    return df.select(
        as_text("snapshot_date"), *(c(n).cast("long").alias(n) for n in counts), "tone"
    )


def market_context(spark, sf):
    return _context(sc.latest_market_context(tt.snapshots(spark, sf)))


def daily_market_context(spark, sf):
    return _context(sc.daily_market_context(tt.snapshots(spark, sf)))


# Calendar, profile, wording ----------------------------------------------------------------------


def market_calendar(spark, sf):
    days = cal.day_spine(tt.table(spark, sf, "orders"), "o_orderdate", "o_orderdate")
    return cal.market_calendar(days).select(as_text("day"), "market", "is_open", "reason")


def markets_open(spark, sf):
    days = cal.day_spine(tt.table(spark, sf, "orders"), "o_orderdate", "o_orderdate")
    open_days = cal.markets_open(cal.market_calendar(days, ["sto", "Finland"]))
    return open_days.select(as_text("day"), "all_open")


def company_profile(spark, sf):
    df = company_profiles(tt.research(spark, sf))
    return df.select(
        "ticker", "country", "total", "business_summary", "presentation", shown("valuation_view"),
        shown("why_it_appeared"), shown("bull_case"), shown("bear_case"),
    )


def public_wording(spark, sf):
    scored = so.strategy_scores(tt.research(spark, sf), ["balanced", "trading", "discovery"])
    return scored.select(
        "strategy", "ticker", "country",
        F.array_join(T.public_risks(F.concat("risks", "warnings")), " | ").alias("public_risks"),
        F.array_join(T.public_reasons(c("reasons")), " | ").alias("public_reasons"),
    )


# Scans -------------------------------------------------------------------------------------------

_QUOTE_OUT = (
    "name", "ticker", "country", "exchange", "segment", "sector", "listing_currency", "price",
    "percentage_change", "turnover", "volume",
)


def json_listing_scan(spark, sf):
    rows = ls.parse_screener(tt.screener_payloads(spark, sf), "payload", "load_order")
    return ls.screener_listings(rows, "load_order").select(*_QUOTE_OUT)


def csv_listing_scan(spark, sf):
    return ls.csv_listings(tt.csv_rows(spark, sf)).select(
        "name", "ticker", "country", "exchange", "segment", "sector", "listing_currency"
    )


def curated_scan(spark, sf, block: int = 500):
    """Research as curated files, one JSON array of companies each, and read again."""
    folder = f"{shared_folder(spark, 'curated')}/files"
    research = tt.research(spark, sf)
    plain = ("name", "ticker", "country", "exchange", "segment", "sector", "market_cap_eur_m")
    financials = F.struct("price", c("price_currency").alias("currency"), *METRIC_COLUMNS, "data_quality")
    company = F.struct(
        *plain, c("listing_currency").alias("currency"), "ir_url", financials.alias("financials"), "catalysts", "risks", "evidence")
    files = research.groupBy(F.floor(c("c_custkey") / block).alias("block")).agg(F.to_json(F.collect_list(company)).alias("value"))
    files.write.partitionBy("block").text(folder)
    return ls.read_curated(spark, folder).select(
        *plain, "listing_currency", "price", "price_currency", "pe_ratio", "data_quality", shown("catalysts"))


def profile_sink(spark, sf):
    """Profiles written as JSON and read again. Every ninth price is no finite number and is written as null."""
    folder = f"{shared_folder(spark, 'profiles')}/files"
    odd = F.when(c("c_custkey") % 18 == 0, float("nan")).otherwise(float("inf"))
    research = tt.research(spark, sf).withColumn("price", F.when(c("c_custkey") % 9 == 0, odd).otherwise(c("price")))
    rp.write_profiles(company_profiles(research), folder)
    shape = ("company struct<ticker:string,country:string,name:string>, financials struct<price:double,pe_ratio:double>, "
             "business_summary string")
    return spark.read.schema(shape).json(folder).select(
        "company.ticker", "company.country", "company.name", "financials.price", "financials.pe_ratio", "business_summary")


def iso_dates(spark, sf):
    """Order days as ISO text, every seventh one broken."""
    key = c("o_orderkey")
    text = F.when(key % 7 == 0, F.lit("1998-02-30")).when(key % 7 == 1, F.lit("May 11")).otherwise(
        c("o_orderdate").cast("date").cast("string"))
    orders = tt.table(spark, sf, "orders").select("o_orderkey", text.alias("text"))
    return orders.select("o_orderkey", "text", iso_date(c("text")).cast("string").alias("day"))


def csv_mixed_headers(spark, sf):
    """Files with their columns in two orders, and one synonym apart, in one folder."""
    folder = f"{shared_folder(spark, 'csv')}/files"
    rows = tt.csv_rows(spark, sf)
    odd = F.pmod(F.xxhash64(*rows.columns), F.lit(2)) == 1
    turned = [F.col(f"`{n}`").alias("Company" if n == "Name" else n) for n in reversed(rows.columns)]
    for part in (rows.where(~odd), rows.where(odd).select(*turned)):
        part.write.mode("append").option("header", True).csv(folder)
    return ls.read_listing_csv(spark, folder).select(
        "name", "ticker", "country", "exchange", "segment", "sector", "listing_currency"
    )


def latest_listing(spark, sf):
    """Segments read one after the other; a symbol seen in an earlier segment is not taken again."""
    base = tt.listing(spark, sf)
    parts = []
    for number, segment in enumerate(K.SEGMENTS):
        part = base.where(c("segment") == segment).withColumn("response", F.lit(number))
        shared = F.concat(F.lit("C"), F.floor(c("c_custkey") / 3).cast("string"))
        parts.append(part.withColumn("ticker", shared))
    universe = parts[0]
    for part in parts[1:]:
        universe = universe.unionByName(part)
    firsts = ls.first_listing(universe, ["response", "ordinal"])
    return firsts.select("ticker", "country", "segment", "name")


def _report_texts(spark, sf):
    """Reports of the trading and long-term lists, as JSON texts."""
    ranked = watchlist(tt.research(spark, sf), ["trading", "long-term"], limit=20)
    items = rp.report_items(with_report_columns(ranked))
    metadata = F.struct(F.lit("2024-02-01T08:00:00Z").alias("generated_at"), "strategy")
    checks = ls.listing_status(tt.listing(spark, sf), "file:customer")
    documents = rp.report_documents(items, metadata, checks)
    return documents.select(
        "strategy", F.to_json(F.struct("disclaimer", "metadata", "source_checks", "items")).alias("text")
    )


def report_scan(spark, sf):
    """Reports are rendered as JSON and scanned back as picks."""
    parsed = _report_texts(spark, sf).select(
        c("strategy").alias("load_order"), F.from_json("text", REPORT).alias("r")
    ).select("load_order", "r.*")
    picks = rp.report_picks(parsed, F.lit("2024-02-01"))
    return picks.select(
        "pick_id", c("rank").cast("long").alias("rank"), "ticker", "country", "entry_price",
        "entry_currency", "score_total", shown("reasons"), shown("warnings"), "report_url",
        c("long_term_conviction.bucket").alias("bucket"), c("long_term_gate.tier").alias("tier"),
        c("long_term_gate.durable_anchor_count").cast("double").alias("anchors"),
        c("long_term_conviction.components")["Growth"]["view"].alias("growth_view"),
    )


# Streams -----------------------------------------------------------------------------------------


def _write_reports(spark, sf, path, block: int = 50, days: Column | None = None, per_file: int = 200):
    """Picks as report files, one document per day, strategy and block of names.

    A block bounds the items that meet in one document, whatever the size of a day, and ``per_file`` the documents
    of a file: readers take report files whole, since a document may lie on many lines. ``days`` takes some report
    days.
    """
    picks = tt.picks(spark, sf)
    if days is not None:
        picks = picks.where(days)
    company = F.struct("ticker", "name", "country", "exchange", "segment", "sector")
    item = F.struct(
        "rank", company.alias("company"),
        F.struct(c("entry_price").alias("price"), c("entry_currency").alias("currency")).alias("financials"),
        F.struct(c("score_total").alias("total"), "reasons", "warnings").alias("score"),
        "risks", "data_quality", "long_term_conviction", "long_term_gate",
    )
    number = F.substring("ticker", 2, 20).cast("long")
    documents = picks.groupBy(
        "report_date", "strategy", F.floor(number / block).alias("block")
    ).agg(F.collect_list(item).alias("items"))
    metadata = F.struct(c("report_date").cast("string").alias("generated_at"), "strategy")
    documents.select("report_date", metadata.alias("metadata"), "items").hint(
        "rebalance", "report_date"
    ).write.mode("append").option("maxRecordsPerFile", per_file).partitionBy("report_date").json(path)


def stream_ledger(spark, sf):
    folder = shared_folder(spark, "ledger-stream")
    _write_reports(spark, sf, f"{folder}/reports")
    ledger = Ledger(spark, f"{folder}/ledger")
    run = stream_ledger_update(report_stream(spark, f"{folder}/reports"), ledger, f"{folder}/progress")
    run.awaitTermination()
    picks = ledger.table("picks").select("pick_id", "entry_price", "entry_currency", "score_total")
    opened = ledger.table("outcomes").groupBy("pick_id").agg(F.count("*").alias("open_outcomes"))
    return picks.join(opened, "pick_id")


def _outcome_rows(ledger):
    return ledger.table("outcomes").select(
        "pick_id", "horizon", as_text("due_date"), as_text("as_of_date"), "status", "price",
        "currency", "return_pct", "benchmark_label", "benchmark_return_pct", "excess_return_pct",
    )


def stream_settlement(spark, sf):
    """Reports and quotes land in three parts; the stream settles after each what is due."""
    folder = shared_folder(spark, "ledger-stream")
    quotes = tt.daily_quotes(spark, sf)
    ledger = Ledger(spark, f"{folder}/ledger")
    for first, last in ((1, 10), (11, 20), (21, 31)):
        _write_reports(spark, sf, f"{folder}/reports", days=F.dayofmonth("report_date").between(first, last))
        run_day = F.dayofmonth("quote_date")
        quotes.where(run_day.between(first, last) & (run_day != 17)).write.mode("append").parquet(f"{folder}/quotes")
        landed = spark.readStream.schema(quotes.schema).parquet(f"{folder}/quotes")
        run = stream_ledger_update(
            report_stream(spark, f"{folder}/reports"), ledger, f"{folder}/progress", quotes=landed)
        run.awaitTermination()
    return _outcome_rows(ledger)


def _run_ledger(spark, sf):
    """A ledger caught up with all run days but the last two, which are run one by one."""
    ledger = Ledger(spark, f"{shared_folder(spark, 'ledger-runs')}/ledger")
    picks, quotes = tt.picks(spark, sf), tt.daily_quotes(spark, sf)
    days = sorted(row[0] for row in tt.run_dates(spark, sf).collect())
    ledger.update_days(picks.where(c("report_date") <= days[-3]), quotes, days[:-2])
    for before, day in zip(days[-3:], days[-2:]):
        reported = picks.where((c("report_date") > before) & (c("report_date") <= day))
        ledger.update(reported, quotes.where(c("quote_date") == day), day)
    return ledger


def ledger_daily_update(spark, sf):
    return _outcome_rows(_run_ledger(spark, sf))


def ledger_summary(spark, sf):
    """The six frames of the summary, written and read again, as (frame, item, figure)."""
    ledger = _run_ledger(spark, sf)
    folder = shared_folder(spark, "summary")
    write_summary(summary_frames(ledger), folder)
    held = {n: spark.read.parquet(f"{folder}/{n}") for n in ("horizons", "signals", "context", "tiers", "ranked", "latest")}
    shape = {
        "horizons": (["strategy", "horizon"], [
            "completed", "hit_rate_pct", "average_return_pct", "median_return_pct", "worst_return_pct", "loss_rate_pct",
            "large_loser_count", "volatility_pct", "average_benchmark_return_pct", "average_excess_return_pct", "excess_hit_rate_pct"]),
        "signals": (["scope", "signal"], ["observations", "average_return_pct", "hit_rate_pct"]),
        "context": (["snapshot_date", "tone"], ["companies", "positive_movers", "selloffs", "active_turnover"]),
        "tiers": (["report_date", "tier"], ["companies"]),
        "ranked": (["list", "scope", "pick_id", "horizon"], ["rank", "return_pct"]),
        "latest": (["pick_id"], ["latest_return_pct"]),
    }
    rows = None
    for name, (keys, figures) in shape.items():
        item = F.concat_ws("|", *(c(k).cast("string") for k in keys))
        opened = F.inline(F.array(*(F.struct(F.lit(n).alias("figure"), c(n).cast("double").alias("value")) for n in figures)))
        one = held[name].select(F.lit(name).alias("frame"), item.alias("item"), opened)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def stream_context(spark, sf):
    folder = shared_folder(spark, "context-stream")
    schema = tt.table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    key = c("user_id")
    quotes = events.select(
        c("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("U"), key.cast("string")).alias("ticker"),
        F.when(key % 2 == 0, "SE").otherwise("FI").alias("country"),
        F.when(key % 50 != 7, c("value")).alias("price"),
        F.lit("EUR").alias("currency"),
        T.texts(
            F.when(c("event_type") == "purchase", f"{K.STRONG_MOMENTUM} (+12%)"),
            F.when(c("event_type") == "click", K.HIGH_TURNOVER),
        ).alias("catalysts"),
        T.texts(F.when(c("event_type") == "error", K.SHARP_SELLOFF)).alias("risks"),
    )
    context = stream_market_context(quotes)
    run = start_context_sink(context, f"{folder}/context", f"{folder}/progress")
    run.awaitTermination()
    return _context(read_context(spark, f"{folder}/context"))


QUERIES: dict[str, Query] = {
    "live_signals": live_signals,
    "base_score": base_score,
    "strategy_scores": strategy_scores,
    "trading_setups": trading_setups,
    "watchlist_balanced": _list("balanced"),
    "watchlist_trading": _list("trading"),
    "watchlist_longterm": _list("long-term"),
    "watchlist_momentum": _list("momentum"),
    "watchlist_discovery": _list("discovery"),
    "watchlist_filtered": _list("balanced", **FILTERS),
    "watchlist_country_quota": _list("balanced", min_country_counts=QUOTA),
    "watchlist_wide_quota": _list("long-term", limit=10, min_country_counts=WIDE_QUOTA),
    "watchlist_all_strategies": all_watchlists,
    "watchlist_long_list": long_list,
    "watchlist_enriched": watchlist_enriched,
    "enrichment_budget": enrichment_budget,
    "dedupe_companies": dedupe_companies,
    "valuation_support": valuation_support,
    "quality_assessment": quality_assessment,
    "longterm_gate": longterm_gate,
    "gate_tier_counts": gate_tier_counts,
    "conviction_components": conviction_components,
    "payload_quote_summary": payload_quote_summary,
    "payload_profile_metrics": payload_profile_metrics,
    "payload_search": payload_search,
    "symbol_candidates": symbol_candidates,
    "first_hit_fundamentals": first_hit_fundamentals,
    "fundamentals_merge": fundamentals_merge,
    "source_coverage": source_coverage,
    "ledger_upsert": ledger_upsert,
    "due_dates": due_dates,
    "weekday_arithmetic": weekday_spine,
    "outcomes": outcomes,
    "country_benchmark": country_benchmark,
    "horizon_scorecard": horizon_scorecard,
    "signal_attribution": signal_attribution,
    "top_signals": top_signals,
    "best_picks": best_picks,
    "worst_picks": worst_picks,
    "market_context": market_context,
    "daily_market_context": daily_market_context,
    "learning_suggestions": learning_suggestions,
    "market_calendar": market_calendar,
    "markets_open": markets_open,
    "company_profile": company_profile,
    "public_wording": public_wording,
    "json_listing_scan": json_listing_scan,
    "csv_listing_scan": csv_listing_scan,
    "csv_mixed_headers": csv_mixed_headers,
    "curated_scan": curated_scan,
    "profile_sink": profile_sink,
    "iso_dates": iso_dates,
    "latest_listing": latest_listing,
    "report_scan": report_scan,
    "stream_ledger_update": stream_ledger,
    "stream_settlement": stream_settlement,
    "ledger_daily_update": ledger_daily_update,
    "ledger_summary": ledger_summary,
    "stream_market_context": stream_context,
}
