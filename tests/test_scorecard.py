"""Scorecard, attribution, best and worst lists, context, suggestions."""

from __future__ import annotations

import datetime as dt
import random
import statistics

from norrsken.operators import scorecard as sc
from norrsken.schemas import SNAPSHOTS

DAY = dt.date(2026, 5, 11)


def outcomes(spark, rows):
    return spark.createDataFrame(
        rows, "pick_id string, strategy string, name string, ticker string, report_url string, horizon string,"
        "status string, return_pct double, benchmark_return_pct double, excess_return_pct double")


def row(i, r, horizon="1d", strategy="trading", status="priced", bench=None, excess=None, name=None):
    return (f"p{i:03d}", strategy, name or f"Firm {i}", f"T{i}", "u", horizon, status, r, bench, excess)


def test_risk_row(spark):
    df = sc.horizon_scorecard(outcomes(spark, [row(1, 20.0, bench=5.0, excess=15.0), row(2, -12.0, bench=0.0, excess=-12.0)]))
    cells = {(r.strategy, r.horizon): r for r in df.collect()}
    r = cells[("trading", "1d")]
    assert (r.worst_return_pct, r.loss_rate_pct, r.large_loser_count, r.volatility_pct) == (-12.0, 50.0, 1, 16.0)
    assert (r.average_benchmark_return_pct, r.average_excess_return_pct, r.excess_hit_rate_pct) == (2.5, 1.5, 50.0)
    empty = cells[("long-term", "60d")]
    assert len(cells) == 8 and (empty.completed, empty.large_loser_count, empty.median_return_pct) == (0, 0, None)


def test_scorecard_equals_python(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        excess = rng.choice([None, rng.randint(-3000, 3000) / 100])
        rows.append(row(i, rng.randint(-2500, 2500) / 100, rng.choice(["1d", "5d"]), rng.choice(["trading", "long-term"]),
                        rng.choice(["priced"] * 5 + ["missing_price"]), bench=excess and excess / 2, excess=excess))
    for r in sc.horizon_scorecard(outcomes(spark, rows)).collect():
        own = [x for x in rows if (x[1], x[5], x[6]) == (r.strategy, r.horizon, "priced")]
        values = [x[7] for x in own]
        assert r.completed == len(values)
        if values:
            n = len(values)
            assert r.hit_rate_pct == round(sum(v > 0 for v in values) / n * 100, 1)
            assert abs(r.average_return_pct - sum(values) / n) <= 0.0051
            ordered = sorted(values)
            assert r.median_return_pct == round((ordered[(n - 1) // 2] + ordered[n // 2]) / 2, 2)
            assert r.worst_return_pct == min(values) and r.large_loser_count == sum(v <= -10 for v in values)
            assert abs(r.volatility_pct - statistics.pstdev(values)) <= 0.0051
            excess = [x[9] for x in own if x[9] is not None]
            assert r.excess_hit_rate_pct == round(sum(v > 0 for v in excess) / len(excess) * 100, 1)


def test_attribution_signals(spark, picks_frame):
    gate = dict(tier="Speculative monitor", durable_anchor_count=2, severe_proof_gap_count=0,
                valuation=dict(primary_kind="market_cap_to_sales"))
    picks = picks_frame(
        dict(pick_id="p001", report_date=DAY, strategy="long-term", segment="first_north", long_term_gate=gate,
             long_term_conviction=dict(bucket="Quality small-cap candidate"),
             reasons=["quality  small-cap CANDIDATE", "Revenue growth 5%", "Net cash balance sheet", "Conservative balance sheet"],
             warnings=["Thin  Liquidity"], risks=["thin liquidity", "other"]),
        dict(pick_id="p002", report_date=DAY, strategy="trading", segment="main_market", country="FI",
             reasons=["High live turnover", "High live turnover"], long_term_conviction=dict(bucket=None), long_term_gate=gate),
        dict(pick_id="p003", report_date=DAY, strategy="trading"),
    )
    rated = outcomes(spark, [row(1, 4.0, "1d", "long-term"), row(1, -2.0, "20d", "long-term"), row(2, 1.0), row(3, 1.0, status="missing_price")])
    rows = sc.signal_attribution(picks, rated).collect()
    long_term = {r.signal: r for r in rows if r.scope == "long-term"}
    assert set(long_term) == {
        "country:SE", "segment:first_north", "reason:Revenue growth 5%", "reason:Net cash balance sheet",
        "reason:Conservative balance sheet", "gate:Speculative monitor", "gate_durable_anchors:2",
        "gate_severe_proof_gaps:0", "valuation_proxy:market_cap_to_sales",
        "quality_bucket:Quality small-cap candidate", "quality:revenue growth",
        "quality:conservative balance sheet", "proof_gap:thin liquidity",
    }
    # The longest completed horizon counts.
    assert {(r.observations, r.average_return_pct, r.hit_rate_pct) for r in long_term.values()} == {(1, -2.0, 0.0)}
    assert {r.signal for r in rows if r.scope == "trading"} == {
        "country:FI", "segment:main_market", "reason:High live turnover", "bucket:None"}
    overall = {r.signal for r in rows if r.scope == "all"}
    assert {"strategy:trading", "strategy:long-term", "country:SE", "country:FI"} <= overall
    assert not any(s.startswith("strategy:") for s in long_term)


def test_suggestions_need_ten_observations(spark):
    df = spark.createDataFrame(
        [("all", "country:SE", 12, 1.5, 60.0), ("all", "reason:low P/B", 12, -0.25, 40.0), ("all", "x:y", 9, 1.0, 1.0)]
        + [("all", f"reason:r{i}", 20 + i, 0.0, 1.0) for i in range(4)] + [("trading", "country:SE", 3, 1.0, 1.0)],
        "scope string, signal string, observations long, average_return_pct double, hit_rate_pct double")
    rows = {}
    for r in sc.learning_suggestions(df).orderBy("scope", "rank").collect():
        rows.setdefault(r.scope, []).append(r.suggestion)
    assert len(rows["all"]) == 5
    assert rows["all"][0].startswith("Reason: R3 has produced a negative average return of 0% across 23 completed")
    assert rows["all"][4].startswith("Country: SE has produced a positive average return of +1.5% across 12 ")
    assert rows["trading"] == rows["long-term"]
    assert rows["trading"][0].startswith("No learning suggestions yet. At least 10")


def test_best_and_worst_lists(spark):
    rows = [row(1, 5.0, name="Acme AB"), row(2, 9.0, name="ACME Oyj"), row(2, 9.0, "5d", name="ACME Oyj"), row(3, -4.0),
            row(4, 7.0, strategy="long-term"), row(5, 1.0), row(6, 2.0), row(7, 3.0), row(8, -9.0), row(9, 50.0, status="missing_price")]
    df = outcomes(spark, rows)
    best = {}
    for r in sc.best_picks(df).orderBy("scope", "rank").collect():
        best.setdefault(r.scope, []).append((r.ticker, r.horizon, r.return_pct))
    assert best["all"] == [("T2", "1d", 9.0), ("T4", "1d", 7.0), ("T7", "1d", 3.0), ("T6", "1d", 2.0), ("T5", "1d", 1.0)]
    assert [t for t, *_ in best["trading"]] == ["T2", "T7", "T6", "T5", "T3"]
    assert [t for t, *_ in best["long-term"]] == ["T4"]
    left = sc.worst_not_best(sc.worst_picks(df), sc.best_picks(df)).collect()
    assert sorted((r.scope, r.ticker) for r in left) == [("all", "T3"), ("all", "T8"), ("trading", "T8")]


def snapshot(spark, *rows):
    return spark.createDataFrame(
        [dict.fromkeys(SNAPSHOTS.names) | dict(snapshot_date=d, ticker=t, catalysts=a, risks=b) for d, t, a, b in rows], SNAPSHOTS)


def test_latest_market_context(spark):
    new = dt.date(2026, 5, 12)
    df = snapshot(
        spark, (DAY, "OLD", ["Strong intraday momentum"], []),
        (new, "AAA", ["Strong intraday momentum (+12.0%)", "High live turnover"], []),
        (new, "BBB", ["Positive intraday momentum (+6.0%)"], None), (new, "CCC", None, ["Sharp intraday selloff"]))
    (r,) = sc.latest_market_context(df).collect()
    assert (r.snapshot_date, r.companies, r.positive_movers, r.selloffs, r.active_turnover) == (new, 3, 2, 1, 1)
    assert r.tone == "Risk-on / broad momentum"
    assert sc.latest_market_context(df.where("false")).count() == 0


def test_market_tone(spark):
    df = spark.createDataFrame([(2, 1), (2, 2), (1, 2), (1, 0), (4, 2), (0, 2), (3, 2)], "m int, s int")
    tones = [r.t for r in df.select(sc.market_tone(df.m, df.s).alias("t")).collect()]
    assert [t.split(" ")[0] for t in tones] == ["Risk-on", "Mixed", "Risk-off", "Mixed", "Risk-on", "Risk-off", "Mixed"]
