"""Signals, base score, strategy scores, trading setups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from norrsken.operators import signals
from norrsken.operators.scoring import normalise_strategies, strategy_scores, with_base_score

CHEAP = dict(
    segment="first_north", market_cap_eur_m=120.0, pe_ratio=9.0, price_to_book=0.9,
    net_cash_eur_m=25.0, debt_to_equity=0.2, operating_margin_pct=8.0, one_year_return_pct=-35.0,
    distance_from_52w_high_pct=-45.0, average_daily_value_eur=45000.0, data_quality="good",
    catalysts=["New contract announced"], risks=["Customer concentration"],
)


def test_base_score_of_a_cheap_small_company(research):
    row = with_base_score(research(CHEAP)).first()
    assert (row.value, row.discovery, row.catalyst, row.risk_penalty, row.total) == (45, 40, 8, 11, 82)
    assert row.reasons[0] == "low P/E (9)" and row.reasons[-1] == "New contract announced"
    assert row.warnings == ["thin liquidity", "1 stated risk(s)"]


def test_catalyst_points_and_cap(research):
    rows = with_base_score(
        research(
            dict(catalysts=["Positive intraday momentum (+5.9%)"]),
            dict(catalysts=["Strong intraday momentum (+14.2%)"]),
            dict(catalysts=["High live turnover"]),
            dict(catalysts=["Moderate live turnover", "Live price available from Nasdaq Nordic"]),
            dict(catalysts=["a", "b", "c", "d"]),
            dict(),
        )
    ).orderBy("ordinal").collect()
    assert [r.catalyst for r in rows] == [3, 7, 8, 6, 24, 0]
    assert [len([x for x in r.reasons if x in "abcd"]) for r in rows][4] == 3


def test_negative_pe_counts_as_low_and_unknowns_do_not_score(research):
    rows = with_base_score(
        research(dict(pe_ratio=-3.0, market_cap_eur_m=None), dict(market_cap_eur_m=None),
                 dict(pe_ratio=80.0, price_to_book=8.0, net_cash_eur_m=-30.0, operating_margin_pct=-12.0,
                      debt_to_equity=2.0, risks=list("abcdefg"), market_cap_eur_m=None, data_quality="thin"))
    ).orderBy("ordinal").collect()
    assert [(r.value, r.discovery) for r in rows] == [(20, 0), (0, 0), (0, 0)]
    assert rows[2].risk_penalty == 8 + 10 + 10 + 8 + 15 and rows[2].data_quality_penalty == 14
    assert rows[2].warnings[-1] == "thin data quality"


def test_market_signals(spark):
    listing = spark.createDataFrame(
        [("A", "SE"), ("B", "SE"), ("C", "SE"), ("D", "FI")], "ticker string, country string"
    )
    quote = spark.createDataFrame(
        [("A", "SE", 34.9, "SEK", 6.25, 10116648.0, 1.0), ("B", "SE", 0.5, "SEK", 155.65, None, None),
         ("C", "SE", None, "SEK", -6.4, 3010.0, None), ("D", "SE", 1.0, "SEK", 1.0, 1.0, 1.0)],
        "ticker string, country string, price double, price_currency string, percentage_change double,"
        "turnover double, volume double",
    )
    rows = {r.ticker: r for r in signals.with_live_signals(listing, quote).collect()}
    assert rows["A"].catalysts == ["Live price available from Nasdaq Nordic",
                                   "Positive intraday momentum (+6.25%)", "High live turnover"]
    assert rows["A"].risks == ["Sparse live-source data"]
    assert rows["B"].catalysts[1] == "Strong intraday momentum (+155.65%)"
    assert rows["B"].risks == ["Sparse live-source data", "Extreme intraday spike",
                               "Speculative low-price share", "Missing live turnover"]
    assert rows["C"].catalysts == []
    assert rows["C"].risks == ["Sparse live-source data", "Sharp intraday selloff", "Low live turnover"]
    assert rows["D"].risks == ["Sparse live-source data"] and rows["D"].catalysts == []


def test_trading_setup(research):
    cases = [
        (["window dressing"], True), (["High live turnover"], True), (["quiet day"], False),
        (["Positive intraday momentum (+6%)"], False),
        (["Positive intraday momentum (+6%)", "Moderate live turnover"], True),
        (["Strong intraday momentum (+12%)"], True), (["Moderate live turnover"], False), ([], False),
        (["intraday momentum report"], False),
    ]
    df = research(*(dict(catalysts=items) for items, _ in cases))
    rows = df.select("ordinal", signals.has_trading_setup(F.col("catalysts")).alias("s")).orderBy("ordinal")
    assert [r.s for r in rows.collect()] == [want for _, want in cases]


def _by(rows, strategy):
    return {r.ticker: r for r in rows if r.strategy == strategy}


def test_discovery_boosts_first_north_and_penalises_spikes(research):
    common = dict(pe_ratio=9.0, price_to_book=0.9, net_cash_eur_m=25.0, market_cap_eur_m=120.0, data_quality="good")
    df = research(
        dict(common, ticker="FIRST", segment="first_north", catalysts=["Moderate live turnover"]),
        dict(common, ticker="SPIKE", segment="first_north", catalysts=["Strong intraday momentum (+155.65%)"],
             risks=["Extreme intraday spike", "Missing live turnover"]),
    )
    rows = _by(strategy_scores(df, "discovery").collect(), "discovery")
    assert rows["FIRST"].catalyst == 8.0 and rows["FIRST"].total == 78.0
    assert "discovery strategy adjustment applied" in rows["FIRST"].reasons
    assert rows["SPIKE"].risk_penalty == 46.0
    assert "discovery strategy adjustment applied" in rows["SPIKE"].warnings


def test_trading_weights_and_reasons(research):
    df = research(dict(CHEAP, catalysts=["Strong intraday momentum (+12%)", "High live turnover", "New order"],
                       risks=["Low live turnover"]))
    row = strategy_scores(df, "trading").first()
    assert (row.value, row.discovery) == (6.75, 10.0)
    assert row.catalyst == 7 + 8 + 8 + 11 and row.risk_penalty == 8 + 3 + 10
    assert row.total == 6.75 + 10 + 34 - 21
    assert row.reasons == ["Strong intraday momentum (+12%)", "High live turnover", "New order",
                           "trading strategy adjustment applied"]


def test_momentum_has_no_adjustment(research):
    df = research(dict(CHEAP, risks=["Extreme intraday spike"]))
    rows = {r.strategy: r for r in strategy_scores(df).collect()}
    assert rows["momentum"].total == 82.0 and rows["balanced"].total == 64.0
    assert set(rows) == {"balanced", "long-term", "trading", "momentum", "discovery"}


def test_long_term_score_parts(research):
    df = research(dict(CHEAP, data_quality="thin", business_description="Makes things.",
                       catalysts=["Strong intraday momentum (+50%)", "New contract announced"],
                       risks=["Extreme intraday spike"], revenue_growth_pct=4.0))
    row = strategy_scores(df, "long-term").first()
    # Quality: first north 5, margin 10, growth 8, net cash 7, low debt 5, cheap 8, text 4. Gaps: liquidity 7, thin 8.
    assert row.quality_adjustment == 47 and row.proof_penalty == 15
    assert row.catalyst == 8 + 47 and row.discovery == 14.0
    assert row.risk_penalty == 8 + 3 + 18 + 18 + 15
    assert row.total == 45 + 14 + 55 - 62 - 14
    assert "Strong intraday momentum (+50%)" not in row.reasons and "New contract announced" in row.reasons
    assert row.warnings.count("Thin liquidity") == 0 and "thin liquidity" in row.warnings
    assert "long-term strategy penalty applied" in row.warnings
    assert [r.lower() for r in row.reasons].count("net cash balance sheet") == 1


def test_long_term_without_anchor(research):
    df = research(dict(market_cap_eur_m=None, catalysts=["Strong intraday momentum (+50%)"], data_quality="thin"))
    row = strategy_scores(df, "long-term").first()
    assert "missing long-term fundamental support" in row.warnings
    assert "Only live-market support" in row.warnings and "Gate tier: Insufficient evidence" in row.warnings
    assert row.total < 0


def test_unknown_strategy_is_refused():
    assert normalise_strategies(" Long-Term ") == ("long-term",)
    with pytest.raises(ValueError, match="strategy must be one of"):
        normalise_strategies("value")
