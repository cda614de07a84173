"""Landing files, reports, profiles, calendar."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from norrsken.operators import calendar as cal
from norrsken.plans.profile import company_profiles, missing_tickers
from norrsken.plans.watchlist import watchlist, with_report_columns
from norrsken.schemas import REPORT
from norrsken.sources import listings as ls
from norrsken.sources import reports as rp


def screener_row(symbol, name="Acast", **changes):
    row = dict(fullName=name, symbol=symbol, currency="SEK", lastSalePrice="34.90", percentageChange="+6.25%",
               turnover="10,116,648", volume="291,265", sector="Technology", isin="SE0015960935")
    return {**row, **changes}


def response(rows, country="SE", segment="main_market", exchange="Nasdaq Stockholm"):
    return dict(country=country, exchange=exchange, segment=segment,
                payload={"data": {"instrumentListing": {"rows": rows}}})


def test_screener_files(spark, tmp_path):
    first = dict(source="nasdaq_nordic_screener", responses=[
        response([screener_row("acast"), screener_row("", "No symbol"), screener_row("NONAME", " ")]),
        response(None), response([screener_row("ACAST", "Second copy"), screener_row("SAME")], segment="First North"),
        response([screener_row("SAME", "Same Oyj", currency="EUR", lastSalePrice=7.75)], country="fi", exchange=""),
        response([screener_row("DEN", isin="DK00")], country=""), response([screener_row("ISN", isin="fi00")], country=""),
    ])
    (tmp_path / "a.json").write_text(json.dumps(first))
    (tmp_path / "b.json").write_text(json.dumps({"data": {"instrumentListing": {"rows": [screener_row("BARE")]}}}))
    (tmp_path / "c.json").write_text(json.dumps({"source": "other", "responses": [response([screener_row("NO")])]}))
    (tmp_path / "d.json").write_text("{ broken")
    rows = ls.screener_listings(ls.read_screener(spark, str(tmp_path)), "file").collect()
    got = {(r.ticker, r.country): r for r in rows}
    assert set(got) == {("ACAST", "SE"), ("SAME", "SE"), ("SAME", "FI"), ("ISN", "FI"), ("BARE", "SE")}
    assert got[("ACAST", "SE")].name == "Acast" and got[("SAME", "SE")].segment == "first_north"
    a = got[("ACAST", "SE")]
    assert (a.price, a.percentage_change, a.turnover, a.volume) == (34.9, 6.25, 10116648.0, 291265.0)
    assert got[("SAME", "FI")].price == 7.75 and got[("SAME", "FI")].exchange == "Nasdaq Nordic"
    assert got[("BARE", "SE")].segment == "other_public"
    status = ls.listing_status(spark.createDataFrame(rows), "u").first()
    assert (status.status, status.detail) == ("ok", "5 companies parsed from u")
    assert ls.listing_status(spark.createDataFrame(rows).where("false"), "u").first().status == "error"
    counted = ls.listing_status(spark.createDataFrame(rows), "u", ls.read_screener(spark, str(tmp_path))).first()
    assert (counted.attempted, counted.parsed, counted.status) == (6, 5, "warning")


def test_live_research_is_thin(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(dict(source="nasdaq_nordic_screener", responses=[response([screener_row("A")])])))
    rows = ls.screener_listings(ls.read_screener(spark, str(tmp_path)), "file").withColumn("ordinal", F.lit(0))
    listing = rows.select("name", "ticker", "country", "exchange", "segment", "sector", "listing_currency", "ordinal")
    row = ls.live_research(listing, rows, "https://x").first()
    assert row.data_quality == "thin" and row.evidence[0].source == "nasdaq" and row.price_currency == "SEK"
    assert row.catalysts == ["Live price available from Nasdaq Nordic", "Positive intraday momentum (+6.25%)", "High live turnover"]


def test_listing_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("Name,Symbol, COUNTRY ,Exchange,Market,Sector,Currency\n"
                    "Header AB, chab ,se,,Main Market,Industrials,SEK\nDane,DK1,DK,X,,,\n,NONAME,SE,,,,\n")
    (row,) = ls.read_listing_csv(spark, str(path)).collect()
    assert (row.ticker, row.country, row.exchange, row.segment) == ("CHAB", "SE", "Nasdaq Nordic", "main_market")
    path.write_text("Name,Country\nx,SE\n")
    with pytest.raises(ValueError, match="required listing columns"):
        ls.read_listing_csv(spark, str(path))


def test_each_csv_file_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,ticker,country\nFirst AB,AAA,SE\n")
    (tmp_path / "b.csv").write_text("ticker,company,country\nBBB,Second Oyj,FI\n")
    (tmp_path / "c.csv").write_text("name,ticker,country\nThird AB,CCC,SE\n")
    rows = ls.read_listing_csv(spark, str(tmp_path)).collect()
    assert {(r.ticker, r.name, r.country) for r in rows} == {
        ("AAA", "First AB", "SE"), ("BBB", "Second Oyj", "FI"), ("CCC", "Third AB", "SE")}


def test_reports_of_several_runs_stay_apart(spark, research, tmp_path):
    df = research(*[dict(SOLID, ticker=t, run=r) for t in "ABC" for r in ("2026-05-11", "2026-05-12")])
    ranked = watchlist(df, ["trading"], limit=2, run_columns=["run"])
    checks = spark.createDataFrame([("s", "ok", "1/1")], "source string, status string, detail string")
    metadata = F.struct(F.col("run").alias("generated_at"), "strategy")
    documents = rp.report_documents(rp.report_items(ranked, ["run"]), metadata, checks, ["run"])
    assert {(r.run, tuple(i["rank"] for i in r["items"])) for r in documents.collect()} == {
        ("2026-05-11", (1, 2)), ("2026-05-12", (1, 2))}


def test_rejected_reports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"metadata": {"strategy": "balanced"}, "items": []}, indent=1))
    (tmp_path / "b.json").write_text("{ broken")
    (tmp_path / "c.json").write_text(json.dumps({"metadata": {"strategy": "trading"}, "items": []}))
    got = rp.rejected_reports(rp.read_reports(spark, str(tmp_path))).collect()
    assert sorted((r.load_order[-6:], r.reason) for r in got) == [("a.json", "strategy without picks"), ("b.json", "unreadable file")]


def test_curated_research_file(spark, tmp_path):
    company = dict(name="Seed Oyj", ticker=" seed ", country="fi", exchange="Nasdaq Helsinki", segment="main_market",
                   sector="Gaming", market_cap_eur_m=330, currency="EUR", ir_url="https://x",
                   financials=dict(price=24.0, currency="EUR", pe_ratio=28.0, average_daily_value_eur=250000, data_quality="partial"),
                   catalysts=["Pipeline"], evidence=[dict(label="IR", url="https://x", source="company")])
    (tmp_path / "a.json").write_text(json.dumps([company, {**company, "ticker": "TWO"}]))
    rows = {r.ticker: r for r in ls.read_curated(spark, str(tmp_path)).collect()}
    r = rows["SEED"]
    assert (r.country, r.market_cap_eur_m, r.price, r.price_currency, r.pe_ratio) == ("FI", 330.0, 24.0, "EUR", 28.0)
    assert r.data_quality == "partial" and r.risks == [] and r.evidence[0].label == "IR" and len(rows) == 2


SOLID = dict(segment="first_north", business_description="Text.", pe_ratio=13.0, net_cash_eur_m=1.0, debt_to_equity=0.2,
             revenue_growth_pct=3.0, operating_margin_pct=3.0, average_daily_value_eur=200000.0, price=12.5,
             price_currency="SEK", catalysts=["Strong intraday momentum (+12%)"])


def test_report_round_trip(spark, research, tmp_path):
    df = research(dict(SOLID, ticker="A"), dict(SOLID, ticker="B", ev_to_ebit=float("nan"), catalysts=["High live turnover"]))
    ranked = with_report_columns(watchlist(df, ["trading", "long-term", "balanced"]))
    checks = spark.createDataFrame([("free fundamentals", "ok", "1/1")], "source string, status string, detail string")
    metadata = F.struct(F.lit("2026-05-11T06:00:00Z").alias("generated_at"), "strategy")
    rp.write_reports(rp.report_documents(rp.report_items(ranked), metadata, checks), str(tmp_path / "r"))
    text = next((tmp_path / "r" / "strategy=long-term").glob("*.json")).read_text()
    doc = json.loads(text)
    assert doc["disclaimer"].startswith("Research triage") and doc["source_checks"][0]["status"] == "ok"
    assert [i["rank"] for i in doc["items"]] == [1, 2]
    assert doc["items"][0]["long_term_conviction"]["components"]["Growth"]["score"] == 3
    assert "NaN" not in text
    reports = rp.read_reports(spark, str(tmp_path / "r"))
    picks = {r.pick_id: r for r in rp.report_picks(reports, F.lit("2026-05-11")).collect()}
    assert set(picks) == {f"2026-05-11|{s}|SE|{t}" for s in ("trading", "long-term") for t in "AB"}
    p = picks["2026-05-11|long-term|SE|A"]
    assert (p.entry_price, p.entry_currency, p.entry_timestamp) == (12.5, "SEK", "2026-05-11T06:00:00Z")
    assert p.long_term_gate.tier and p.report_url == "../reports/long-term/2026-05-11.html"
    assert picks["2026-05-11|trading|SE|A"].long_term_gate is None
    assert {r.strategy for r in rp.unknown_strategies(reports).collect()} == {"balanced"}


def test_later_copy_of_a_pick_wins(spark):
    item = dict(rank=1, company=dict(ticker="a", country="se"), score=dict(total=1.0))
    docs = [(1, dict(metadata=dict(strategy=" trading "), items=[item, {**item, "rank": 7}])),
            (0, dict(metadata=dict(strategy="trading"), items=[{**item, "rank": 3}]))]
    df = spark.createDataFrame([(n, json.dumps(d)) for n, d in docs], "load_order int, text string")
    reports = df.select("load_order", F.from_json("text", REPORT).alias("r")).select("load_order", "r.*")
    (p,) = rp.report_picks(reports, F.lit("2026-05-11")).collect()
    assert (p["rank"], p.pick_id, p.reasons) == (7, "2026-05-11|trading|SE|A", [])


def test_profiles(spark, research, tmp_path):
    df = research(
        dict(SOLID, ticker="A", evidence=[("l", "u", "nasdaq", None)], one_year_return_pct=-12.25),
        dict(ticker="A", country="FI"), dict(ticker="B", sector=None, market_cap_eur_m=99.95, net_cash_eur_m=-4.5, pe_ratio=-1.0),
        dict(ticker="C", market_cap_eur_m=None),
    )
    wanted = spark.createDataFrame([(" a ",), ("b",), ("zz",), ("c",)], "ticker string")
    profiles = company_profiles(df, wanted)
    rows = {r.ticker: r for r in profiles.collect()}
    assert set(rows) == {"A", "B", "C"} and rows["A"].country == "SE"
    assert [r.ticker for r in missing_tickers(df, wanted).collect()] == ["ZZ"]
    assert rows["A"].valuation_view == ["Live price is 12.5 SEK from Nasdaq Nordic.", "P/E is 13.",
                                        "Price/book is unavailable in the current dataset.", "Net cash is EUR 1m."]
    assert rows["A"].presentation == (
        "A AB is a Sweden-listed First North Software company on Nasdaq Stockholm. Market cap is about EUR 180m, "
        "revenue growth is 3.0%, operating margin is 3.0%, and one-year return is -12.2%.")
    assert rows["B"].valuation_view == ["P/E is unavailable in the current dataset.",
                                        "Price/book is unavailable in the current dataset.", "Net debt is EUR 4.5m."]
    assert rows["B"].presentation.endswith("main market company on Nasdaq Stockholm. Market cap is about EUR 100.0m.")
    assert rows["B"].business_summary == "B AB is a SE-listed unknown sector company on Nasdaq Stockholm."
    assert rows["C"].presentation.endswith("on Nasdaq Stockholm.")
    assert rows["C"].why_it_appeared[0].startswith("Scoring did not surface") and len(rows["C"].next_manual_checks) == 4
    rp.write_profiles(profiles, str(tmp_path / "p"))
    docs = [json.loads(x) for f in (tmp_path / "p").glob("*.json") for x in f.read_text().splitlines()]
    assert {d["company"]["ticker"] for d in docs} == {"A", "B", "C"} and docs[0]["base_case"]


def test_calendar(spark):
    days = [dt.date(2026, 5, 14), dt.date(2026, 5, 15), dt.date(2025, 6, 6), dt.date(2024, 12, 6), dt.date(2026, 6, 19),
            dt.date(2008, 5, 1), dt.date(2026, 4, 3), dt.date(2026, 4, 6), dt.date(2026, 12, 26), dt.date(2026, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "day date")
    rows = {(r.day, r.market): r for r in cal.market_calendar(df).collect()}
    reason = {d: (rows[(d, "stockholm")].reason, rows[(d, "helsinki")].reason) for d in days}
    assert reason[days[0]] == ("Ascension Day",) * 2 and reason[days[1]] == (None, None)
    assert reason[days[2]] == ("Swedish National Day", None) and reason[days[3]] == (None, "Finnish Independence Day")
    assert reason[days[4]] == ("Midsummer Eve",) * 2 and reason[days[5]] == ("Ascension Day",) * 2
    assert reason[days[6]] == ("Good Friday",) * 2 and reason[days[7]] == ("Easter Monday",) * 2
    assert reason[days[8]] == ("Weekend",) * 2 and reason[days[9]] == ("New Year's Eve",) * 2
    both = {r.day: r.all_open for r in cal.markets_open(cal.market_calendar(df)).collect()}
    assert both[days[1]] and not both[days[2]] and not both[days[0]]


def test_market_names(spark):
    df = spark.createDataFrame([(" STO ",), ("nasdaq helsinki",), ("oslo",)], "m string")
    assert [r.n for r in df.select(cal.normalise_market(F.col("m")).alias("n")).collect()] == ["stockholm", "helsinki", None]
    assert cal.market_names(["se", "FI"]) == ["helsinki", "stockholm"]
    with pytest.raises(ValueError, match="unsupported market 'oslo'"):
        cal.market_names(["oslo"])


def test_many_csv_files_are_one_scan(spark, tmp_path):
    for n in range(200):
        rows = f"Firm {n} AB,T{n},SE\n" if n % 2 else f'se,"T{n}","Firm, {n} ""AB"""\n'
        head = "name,ticker,country\n" if n % 2 else "country;,x\n".replace(";,x", ",SYMBOL,Company")
        (tmp_path / f"{n}.csv").write_text(head + rows + "\n")
    df = ls.read_listing_csv(spark, str(tmp_path))
    rows = {r.ticker: r.name for r in df.collect()}
    assert len(rows) == 200 and rows["T1"] == "Firm 1 AB" and rows["T2"] == 'Firm, 2 "AB"'
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_broken_files_are_counted_while_reading(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(dict(source="nasdaq_nordic_screener", responses=[response([screener_row("A"), screener_row("B")])])))
    (tmp_path / "b.json").write_text("{ broken")
    seen = Observation("scan")
    listing = ls.screener_listings(ls.observed_scan(ls.read_screener(spark, str(tmp_path)), seen), "file")
    parsed = len(listing.collect())
    assert (parsed, seen.get) == (2, {"rows": 3, "broken": 1})
    row = ls.observed_status(spark, parsed, seen.get["broken"], "u").first()
    assert (row.attempted, row.parsed, row.status, row.detail) == (3, 2, "warning", "2 companies parsed from u, 1 files unreadable")
    assert ls.observed_status(spark, 0, 0, "u").first().status == "error"


def test_a_stream_reports_its_broken_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"metadata": {"strategy": "trading"}, "items": []}))
    (tmp_path / "in" / "b.json").write_text("{ broken")
    files = spark.readStream.schema("value string").text(str(tmp_path / "in"), wholetext=True)
    reports = ls.observed_scan(rp.report_rows(files.withColumn("load_order", F.lit("x"))), "reports")
    run = reports.writeStream.foreachBatch(lambda df, n: df.collect() and None).option(
        "checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert ls.observed_counts(run, "reports") == {"rows": 2, "broken": 1}
