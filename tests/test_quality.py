"""Quality, valuation, gate and conviction components."""

from __future__ import annotations

from norrsken.operators.conviction import COMPONENTS, with_components, with_conviction
from norrsken.operators.quality import tier_counts, with_gate, with_quality, with_thesis, with_valuation
from norrsken.operators.scoring import strategy_scores

GOOD = dict(
    segment="first_north", business_description="Builds wooden bridges.", pe_ratio=11.0,
    price_to_book=1.3, net_cash_eur_m=8.0, debt_to_equity=0.3, revenue_growth_pct=9.0,
    operating_margin_pct=13.0, average_daily_value_eur=310000.0,
)
BLANK = dict(
    pe_ratio=None, price_to_book=None, net_cash_eur_m=None, debt_to_equity=None,
    revenue_growth_pct=None, operating_margin_pct=None,
)


def assessed(research, *rows):
    return with_thesis(with_gate(with_quality(research(*rows)))).orderBy("ordinal").collect()


def test_durable_fundamentals_reach_the_top(research):
    (row,) = assessed(research, GOOD)
    assert row.bucket == "Quality small-cap candidate" and row.proof_penalty == 0
    assert row.quality_reasons[0] == "First North discovery opportunity"
    assert row.gate.tier == "High-conviction candidate" and row.gate.durable_anchor_count == 6
    assert row.gate.reasons[-1] == "valuation support available" and row.gate.blockers == []
    assert row.thesis.startswith("QUAL AB has multiple long-term quality signals")


def test_live_only_support_is_not_enough(research):
    spec = {**GOOD, **BLANK, "business_description": None, "average_daily_value_eur": 40000.0,
            "catalysts": ["Strong intraday momentum (+18.0%)", "High live turnover"],
            "risks": ["Sparse live-source data"], "data_quality": "thin", "market_cap_eur_m": None}
    (row,) = assessed(research, spec)
    assert row.bucket == "Insufficient evidence" and row.gate.tier == "Insufficient evidence"
    for gap in ("Missing valuation data", "No profitability signal", "No growth signal", "Thin liquidity",
                "Only live-market support", "Thin data quality"):
        assert gap in row.proof_gaps
    assert row.gate.blockers == ["no profitability signal", "missing business description",
                                 "thin data quality", "missing valuation support"]


def test_speculative_and_missing_liquidity(research):
    monitor = {**GOOD, **BLANK, "market_cap_eur_m": 180.0, "debt_to_equity": 0.4, "revenue_growth_pct": 4.0,
               "average_daily_value_eur": 120000.0}
    quiet = {**GOOD, "average_daily_value_eur": None}
    one, two = assessed(research, monitor, quiet)
    assert one.bucket == "Speculative small-cap monitor"
    assert one.thesis.endswith("because no profitability signal.")
    assert "Missing liquidity data" in two.proof_gaps and two.bucket != "Quality small-cap candidate"
    assert two.proof_penalty == 9.0  # 6 for the gap, 3 for partial data with a gap


def test_zero_margin_is_no_signal_and_negative_margin_demotes(research):
    zero, minus = assessed(
        research, {**GOOD, "operating_margin_pct": 0.0},
        {**GOOD, "operating_margin_pct": -8.0, "revenue_growth_pct": 20.0, "pe_ratio": 8.0},
    )
    assert "No profitability signal" in zero.proof_gaps
    assert minus.gate.tier != "High-conviction candidate"
    assert "negative operating margin" in minus.gate.blockers


def test_valuation_order_and_proxies(research):
    cases = [
        (dict(pe_ratio=20.0, price_to_book=0.5), ("pe_ratio", 20.0, False, "P/E is 20.")),
        (dict(pe_ratio=-2.0, price_to_book=1.5), ("price_to_book", 1.5, True, "Price/book is 1.5.")),
        (dict(ev_to_ebit=12.0), ("ev_to_ebit", 12.0, True, "EV/EBIT is 12.")),
        (dict(revenue_eur_m=120.0), ("market_cap_to_sales", 1.5, True, "Market cap/sales is 1.5x.")),
        (dict(book_value_eur_m=100.0, revenue_eur_m=-1.0), ("market_cap_to_book", 1.8, False, "Market cap/book value is 1.8x.")),
        (dict(net_cash_eur_m=36.0), ("net_cash_to_market_cap", 20.0, True, "Net cash equals 20% of market cap.")),
        (dict(net_income_eur_m=9.0), ("earnings_yield_pe", 20.0, False, "Implied P/E is 20.")),
        (dict(), (None, None, False, "No valuation metric or proxy is available.")),
        (dict(revenue_eur_m=120.0, market_cap_eur_m=None), (None, None, False, "No valuation metric or proxy is available.")),
        # Judged after rounding to two decimals.
        (dict(revenue_eur_m=90.0, market_cap_eur_m=180.36), ("market_cap_to_sales", 2.0, True, "Market cap/sales is 2x.")),
    ]
    rows = with_valuation(research(*(row for row, _ in cases))).orderBy("ordinal").collect()
    for row, (_, want) in zip(rows, cases):
        v = row.valuation
        assert (v.primary_kind, v.primary_value, v.is_attractive, v.summary) == want


def test_watchlist_bucket_needs_three_anchors(research):
    few = dict(segment="main_market", business_description="Text.", pe_ratio=20.0, operating_margin_pct=5.0,
               revenue_growth_pct=3.0, average_daily_value_eur=90000.0, data_quality="good", debt_to_equity=1.0)
    (row,) = assessed(research, few)
    assert row.bucket == "Fundamental watchlist candidate" and row.gate.durable_anchor_count == 3
    assert row.gate.tier == "High-conviction candidate"


def test_tier_counts_show_every_tier(research):
    spec = {**BLANK, "market_cap_eur_m": None, "data_quality": "thin"}
    rows = tier_counts(with_gate(with_quality(research(GOOD, GOOD, dict(spec, sector="X"))))).collect()
    assert {r.tier: r.companies for r in rows} == {
        "High-conviction candidate": 2, "Fundamental watchlist": 0, "Speculative monitor": 0,
        "Insufficient evidence": 1,
    }
    assert not any(r.no_high_conviction for r in rows)
    by_sector = tier_counts(with_gate(with_quality(research(GOOD, dict(spec, sector="X")))), "sector").collect()
    assert {r.sector: r.no_high_conviction for r in by_sector} == {"Software": False, "X": True}
    assert len(by_sector) == 8


def components(research, *rows):
    scored = strategy_scores(research(*rows), "long-term")
    return [
        {x.name: (x.score, x.view) for x in r.components}
        for r in with_components(scored).orderBy("ordinal").collect()
    ]


def test_components(research):
    good, blank, mixed = components(
        research, {**GOOD, "operating_margin_pct": 15.0, "data_quality": "good", "risks": ["low cash", "b", "c"]},
        {**BLANK, "market_cap_eur_m": None, "data_quality": "thin"},
        {**BLANK, "debt_to_equity": 1.2, "revenue_growth_pct": -4.25, "operating_margin_pct": -2.0, "pe_ratio": 30.0,
         "one_year_return_pct": 80.0, "risks": ["Extreme intraday spike"], "market_cap_eur_m": None},
    )
    assert {n: good[n][0] for n in COMPONENTS} == {
        "Business quality": 5, "Valuation": 5, "Growth": 4, "Balance sheet": 5, "Momentum": 2, "Risk": 3,
        "Data confidence": 5,
    }
    assert good["Growth"][1] == "Healthy revenue growth of 9.0%."
    assert good["Risk"][1] == "Low cash; B"
    assert {n: blank[n][0] for n in COMPONENTS} == {
        "Business quality": 0, "Valuation": 1, "Growth": 1, "Balance sheet": 1, "Momentum": 2, "Risk": 2,
        "Data confidence": 0,
    }
    assert mixed["Growth"] == (1, "Revenue declined 4.2%.")
    assert mixed["Momentum"][0] == 1 and mixed["Risk"][0] == 1 and mixed["Balance sheet"][0] == 3
    assert mixed["Valuation"][0] == 2 and mixed["Data confidence"][0] == 3


def test_conviction_record(research):
    row = with_conviction(strategy_scores(research(GOOD), "long-term")).first()
    assert row.conviction.bucket == "Quality small-cap candidate"
    assert set(row.conviction.components) == set(COMPONENTS)
    assert row.conviction.components["Balance sheet"].score == 5
