"""Payload parsers, lookups, merge and coverage."""

from __future__ import annotations

import json

from norrsken.operators import enrichment as en
from norrsken.sources import fundamentals as fu
from tests.test_ranking import fundamentals_frame


def payloads(spark, *rows):
    return spark.createDataFrame(
        [(s, p if isinstance(p, str) else json.dumps(p), cur) for s, p, cur in rows],
        "symbol string, payload string, fallback_currency string",
    )


def summary(**changes):
    result = {
        "price": {"currency": "SEK", "marketCap": {"raw": 7_300_000_000}},
        "summaryDetail": {"trailingPE": {"raw": 9.6}, "priceToBook": 1.7,
                          "averageDailyVolume10Day": {"raw": 310_000}, "previousClose": {"raw": "64.0"}},
        "financialData": {"revenueGrowth": {"raw": 0.05}, "operatingMargins": {"raw": 0.21},
                          "debtToEquity": {"raw": 37.0}, "totalCash": {"raw": 820_000_000},
                          "totalDebt": {"raw": 440_000_000}},
    }
    result.update(changes)
    return {"quoteSummary": {"result": [result], "error": None}}


def test_quote_summary(spark):
    df = fu.parse_quote_summary(payloads(
        spark, ("TALL.ST", summary(), None), ("FIR&A.HE", summary(price={}), "eur"),
        ("DKK.ST", summary(price={"currency": "DKK", "marketCap": 5}), "SEK"),
        ("EMPTY.ST", {"quoteSummary": {"result": []}}, "SEK"), ("BAD.ST", "not json", "SEK"),
        ("NONE.ST", {"quoteSummary": {"result": [{"price": {"currency": "SEK"}}]}}, "SEK"),
        ("BOOL.ST", summary(financialData={}, price={}, summaryDetail={"trailingPE": True, "priceToBook": {"fmt": "1"}}), "SEK"),
    ))
    rows = {r.symbol: r for r in df.collect()}
    assert set(rows) == {"TALL.ST", "FIR&A.HE", "DKK.ST"}
    r = rows["TALL.ST"]
    assert (r.market_cap_eur_m, r.pe_ratio, r.price_to_book) == (730.0, 9.6, 1.7)
    assert (r.revenue_growth_pct, r.operating_margin_pct, r.debt_to_equity) == (5.0, 21.0, 0.37)
    assert r.net_cash_eur_m == 38.0 and r.average_daily_value_eur == 310_000 * 64.0 * 0.1
    assert r.evidence_item.label == "Yahoo-style fundamentals lookup (TALL.ST)"
    assert rows["FIR&A.HE"].net_cash_eur_m == 380.0 and "FIR%26A.HE?modules" in rows["FIR&A.HE"].evidence_item.url
    # No rate for the currency: amounts stay unknown, ratios do not.
    assert rows["DKK.ST"].market_cap_eur_m is None and rows["DKK.ST"].pe_ratio == 9.6


def test_profile_metrics(spark):
    metric = {"peBasicExclExtraTTM": None, "peNormalizedAnnual": 9.6, "pbQuarterly": True, "pbAnnual": "1.7",
              "revenueGrowthTTMYoy": 5.0, "operatingMarginTTM": 21.0, "totalDebt/totalEquityQuarterly": 37.0}
    df = fu.parse_profile_metrics(payloads(
        spark, ("TALL.ST", {"profile": {"currency": "sek", "marketCapitalization": 7300.0}, "metrics": {"metric": metric}}, None),
        ("NO.ST", {"profile": {}, "metrics": {}}, "SEK"), ("BAD.ST", "{", "SEK"),
    ))
    (r,) = df.collect()
    assert (r.market_cap_eur_m, r.pe_ratio, r.price_to_book, r.debt_to_equity) == (730.0, 9.6, 1.7, 0.37)
    assert r.evidence_item.source == "finnhub"


def test_search_and_profile(spark):
    item = {"symbol": "tall.st", "currency": "SEK", "regular_market_price": 41.5, "average_daily_volume_10_day": 120300,
            "one_year_return": -8.125, "fifty_two_week_high_change_percent": -21.75, "amount": 3917250000,
            "revenue_growth": 0.11384, "net_margin": 0.20716, "debt_to_equity": 0.41}
    other = {**item, "symbol": "OTHER.ST", "amount": 1}
    search = payloads(
        spark, ("TALL.ST", {"result": {"items": [other, item, other]}}, None),
        ("GONE.ST", {"result": {"items": [other]}}, None), ("EMPTY.ST", {"result": {"items": []}}, None),
        ("NULL.ST", {"result": None}, None),
    )
    (hit,) = fu.parse_search(search).collect()
    assert hit.symbol == "tall.st" and hit.market_cap_eur_m == 391.73
    assert (hit.revenue_growth_pct, hit.operating_margin_pct) == (11.38, 20.72)
    assert hit.average_daily_value_eur == round(41.5 * 120300 * 0.1, 2)
    assert hit.one_year_return_pct == -8.125
    profile = payloads(
        spark, ("TALL.ST", {"result": {"items": [{"symbol": "TALL.ST", "long_business_summary": " Pine\n boards. ", "ir_website": ""}]}}, None),
        ("X.ST", {"result": {"items": [{"symbol": "X.ST", "long_business_summary": " ", "ir_website": None}]}}, None),
    )
    texts = fu.parse_profile_text(profile)
    assert [(r.symbol, r.business_description, r.ir_url) for r in texts.collect()] == [("TALL.ST", "Pine boards.", None)]
    joined = en.with_profile_text(fu.parse_search(search), texts.unionByName(texts))
    assert joined.count() == 1
    assert joined.first().business_description == "Pine boards." and joined.first().market_cap_eur_m == 391.73
    alone = en.with_profile_text(fu.parse_search(search), texts.where("false")).first()
    assert alone.business_description is None and alone.market_cap_eur_m == 391.73


def test_first_hit_takes_the_earlier_symbol(spark):
    companies = spark.createDataFrame([("VOLV B", "SE"), ("ABB B", "SE"), ("NO", "FI"), ("X", "DK")], "ticker string, country string")
    facts = fundamentals_frame(spark, [dict(symbol="volv-b.st", pe_ratio=1.0), dict(symbol="VOLVB.ST", pe_ratio=2.0),
                                       dict(symbol="ABBB.ST", pe_ratio=3.0)])
    rows = {r.ticker: r for r in en.first_hits(companies, facts).collect()}
    assert {t: (r.pe_ratio, r.hit_attempt) for t, r in rows.items()} == {"VOLV B": (1.0, 0), "ABB B": (3.0, 1)}
    row = en.coverage(companies, facts, "s").withColumn("detail", en.coverage_detail("Test")).first()
    assert (row.attempted, row.parsed, row.status, row.detail) == (4, 2, "warning", "2/4 Test lookups parsed")


def test_coverage_states(spark):
    companies = spark.createDataFrame([("A", "SE")], "ticker string, country string")
    facts = fundamentals_frame(spark, [dict(symbol="A.ST", pe_ratio=1.0)])
    detail = en.coverage_detail("Test")
    full = en.coverage(companies, facts, "s").withColumn("detail", detail).first()
    none = en.coverage(companies, facts.where("false"), "s").withColumn("detail", detail).first()
    idle = en.coverage(companies.where("false"), facts, "s").withColumn("detail", detail).first()
    assert (full.status, none.status, idle.status) == ("ok", "warning", "warning")
    assert none.detail == "No successful Test fundamentals lookups (0/1 Test lookups parsed)"
    assert idle.detail == "No lookups attempted for Test fundamentals"


def test_merge_fills_only_unknown_fields(spark, research):
    base = research(
        dict(ticker="A", data_quality="thin", pe_ratio=5.0, market_cap_eur_m=None, price=3.0),
        dict(ticker="B", data_quality="thin", pe_ratio=5.0, market_cap_eur_m=1.0),
        dict(ticker="C", data_quality="thin"), dict(ticker="D", data_quality="good", market_cap_eur_m=None),
    )
    facts = fundamentals_frame(spark, [
        dict(symbol="A.ST", pe_ratio=9.0, price_to_book=1.0, market_cap_eur_m=77.0, one_year_return_pct=-3.0,
             business_description="Text", ir_url="u"),
        dict(symbol="B.ST", pe_ratio=9.0, one_year_return_pct=-3.0, business_description="Text"),
        dict(symbol="D.ST", market_cap_eur_m=5.0),
    ])
    rows = {r.ticker: r for r in en.merge_fundamentals(base, en.first_hits(base, facts)).collect()}
    a, b, none, d = rows["A"], rows["B"], rows["C"], rows["D"]
    assert (a.pe_ratio, a.price_to_book, a.market_cap_eur_m, a.one_year_return_pct) == (5.0, 1.0, 77.0, None)
    assert (a.data_quality, a.business_description, a.ir_url, a.price, len(a.evidence)) == ("partial", "Text", "u", 3.0, 1)
    # Text and price context alone do not lift the quality; the evidence is still added.
    assert (b.data_quality, b.business_description, len(b.evidence)) == ("thin", "Text", 1)
    assert none.evidence == [] and none.data_quality == "thin"
    assert (d.data_quality, d.market_cap_eur_m) == ("good", 5.0)
