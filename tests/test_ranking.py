"""Dedupe, ranks, quotas and enriched watchlists against plain Python."""

from __future__ import annotations

import random

import pytest

from norrsken.operators.ranking import best_per_company, company_filter, select_top
from norrsken.operators.scoring import strategy_scores
from norrsken.plans import queries, watchlist as watchlist_plan
from norrsken.plans.watchlist import watchlist
from norrsken.schemas import FILLABLE_METRICS
from norrsken.operators.enrichment import FUNDAMENTAL_COLUMNS
from norrsken.schemas import EVIDENCE
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from tests.conftest import SF
from tests.test_functions import _key


def greedy_quota(ranked, limit, quotas):
    """One swap after the other, as a person would do it. ranked: (ticker, country) best first."""
    chosen = ranked[:limit]
    need = {k.upper(): v for k, v in quotas.items()}
    for country, count in quotas.items():
        country = country.upper()
        lacking = count - sum(c == country for _, c in chosen)
        for fresh in [r for r in ranked[limit:] if r[1] == country and r not in chosen][: max(lacking, 0)]:
            spare = None
            for place in range(len(chosen) - 1, -1, -1):
                own = chosen[place][1]
                if sum(c == own for _, c in chosen) > need.get(own, 0):
                    spare = place
                    break
            if spare is None:
                break
            chosen.pop(spare)
            chosen.append(fresh)
    return sorted(chosen, key=ranked.index)


@pytest.mark.parametrize("fits", [True, False])
def test_quota_equals_one_by_one_swaps(spark, fits):
    rng = random.Random(11 + fits)
    quotas = {"FI": 3, "no": 1} if fits else {"FI": 4, "SE": 3, "NO": 2}
    limit = 6 if fits else 5
    cases, rows = {}, []
    for case in range(150):
        people = [
            (f"T{case}x{i}", rng.choice(["SE", "SE", "FI", "NO", "DK"])) for i in range(rng.randint(1, 16))
        ]
        if case % 3 == 0:
            people = [(t, rng.choice(["SE", "DK"] * 4 + ["FI"])) for t, _ in people]
        cases[str(case)] = people
        rows += [(str(case), t, k, float(100 - i), i) for i, (t, k) in enumerate(people)]
    ideas = spark.createDataFrame(rows, "strategy string, ticker string, country string, total double, ordinal long")
    got = {}
    for r in select_top(ideas, limit, quotas).orderBy("strategy", "rank").collect():
        got.setdefault(r.strategy, []).append((r.ticker, r.country, r["rank"]))
    for case, ranked in cases.items():
        want = greedy_quota(ranked, limit, quotas)
        assert [(t, k) for t, k, _ in got[case]] == want, case
        assert [n for *_, n in got[case]] == list(range(1, len(want) + 1))


def test_long_lists_equal_the_windows(spark):
    """Beyond the session's limit for windows: many ties, null groups, a quota, no group in one task."""
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), f"T{i % 600}", rng.choice(["SE", "SE", "FI", None]), rng.choice([1.0, 2.5, 2.51, 9.0]), i)
            for i in range(2000)]
    ideas = spark.createDataFrame(rows, "strategy string, ticker string, country string, total double, ordinal long")
    for quotas in (None, {"FI": 90}):
        want = sorted(map(str, select_top(ideas, 150, quotas).collect()))
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "20")
        try:
            long = select_top(ideas, 150, quotas)
            plan = long._jdf.queryExecution().executedPlan().toString()
            assert sorted(map(str, long.collect())) == want and len(want) == 450
            # Windows see counted scores and parts only, never the rows.
            assert "ticker" not in "".join(line for line in plan.splitlines() if "Window" in line)
            with pytest.raises(ValueError, match="quotas that exceed"):
                select_top(ideas, 30, {"FI": 20, "SE": 20})
        finally:
            spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_quota_examples(research):
    rows = [dict(ticker=t, catalysts=["High live turnover"]) for t in ("SEA", "SEB", "SEC", "SED")]
    rows += [dict(ticker=t, country="FI") for t in ("FIA", "FIB", "FIC")]
    got = watchlist(research(*rows), limit=5, min_country_counts={"FI": 3}).orderBy("rank").collect()
    assert [r.country for r in got].count("FI") == 3 and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    got = watchlist(research(*rows[:2], rows[4]), limit=5, min_country_counts={"fi": 3}).collect()
    assert len(got) == 3


def test_dedupe_keeps_best_share_class_and_first_of_equals(research):
    df = research(
        dict(name="Acme AB A", ticker="ACM-A"), dict(name="Acme AB ser. B", ticker="X"),
        dict(name="ACME ab b", ticker="ACM-B", catalysts=["x"]), dict(name="AB", ticker="AB1"),
        dict(name="Twin AB", ticker="TW", country="SE"), dict(name="Twin Oyj", ticker="TW", country="FI"),
    )
    rows = best_per_company(strategy_scores(df, "balanced")).collect()
    assert {r.company_key: (r.ticker, r.country) for r in rows} == {
        "acme": ("ACM-B", "SE"), "acme ab ser": ("X", "SE"), "ab1|SE": ("AB1", "SE"), "twin": ("TW", "SE"),
    } or {r.company_key for r in rows} == {"acme", "acme ab ser", "AB1|SE", "twin"}
    twin = next(r for r in rows if r.company_key == "twin")
    assert twin.country == "SE"


def test_filters(research):
    df = research(
        dict(ticker="A", market_cap_eur_m=100.0, sector=" software "), dict(ticker="B", market_cap_eur_m=None),
        dict(ticker="C", country="FI", market_cap_eur_m=100.0), dict(ticker="D", segment="first_north"),
        dict(ticker="E", market_cap_eur_m=900.0), dict(ticker="F", sector=None, market_cap_eur_m=100.0),
    )

    def names(**options):
        return [r.ticker for r in company_filter(df, **options).orderBy("ordinal").collect()]

    assert names(countries=["se"]) == ["A", "B", "D", "E", "F"]
    assert names(include_first_north=False) == ["A", "B", "C", "E", "F"]
    assert names(min_market_cap=100, max_market_cap=500, sector="Software") == ["A", "C", "D"]
    assert names(max_market_cap=100) == ["A", "C", "F"]


def test_limit_and_strategy_are_checked_first(research):
    with pytest.raises(ValueError, match="limit"):
        watchlist(research(dict()), limit=0)
    with pytest.raises(ValueError, match="strategy"):
        watchlist(research(dict()), "nope")


def test_long_term_ranks_tier_before_score(research):
    solid = dict(segment="first_north", business_description="x", pe_ratio=13.0, net_cash_eur_m=1.0,
                 debt_to_equity=0.2, revenue_growth_pct=3.0, operating_margin_pct=3.0,
                 average_daily_value_eur=200000.0, market_cap_eur_m=None)
    loud = dict(solid, operating_margin_pct=-1.0, pe_ratio=5.0, price_to_book=0.5, market_cap_eur_m=10.0,
                catalysts=["a", "b"])
    got = watchlist(research(dict(loud, ticker="LOUD"), dict(solid, ticker="SOLID")), "long-term").orderBy("rank").collect()
    assert [r.ticker for r in got] == ["SOLID", "LOUD"] and got[0].total < got[1].total


def test_runs_are_ranked_apart(research):
    df = research(*(dict(ticker=f"T{i}", run=day, catalysts=["x"] * (i % 3)) for i in range(6) for day in ("d1", "d2")))
    got = watchlist(df, limit=2, run_columns=["run"]).collect()
    assert sorted((r.run, r["rank"], r.ticker) for r in got) == [
        ("d1", 1, "T2"), ("d1", 2, "T5"), ("d2", 1, "T2"), ("d2", 2, "T5")
    ]


def fundamentals_frame(spark, rows):
    schema = StructType(
        [StructField("symbol", StringType())]
        + [StructField(n, StringType() if n in ("business_description", "ir_url") else DoubleType())
           for n in FUNDAMENTAL_COLUMNS]
        + [StructField("evidence_item", EVIDENCE)]
    )
    return spark.createDataFrame(
        [{**dict.fromkeys(schema.names), **r, "evidence_item": ("label", "url", "src", None)} for r in rows], schema
    )


def test_enriched_list_equals_scoring_everything_in_python_order(spark, research):
    """The bounded plan against the direct reading: enrich chosen rows in place, rank all rows."""
    rng = random.Random(5)
    rows, facts = [], []
    for i in range(80):
        ticker = f"T{i:03d}"
        rows.append(dict(
            ticker=ticker, name=f"Firm {rng.randint(0, 30)} {rng.choice(['AB', 'B', 'Oyj'])}",
            country=rng.choice(["SE", "SE", "FI"]), data_quality="thin", market_cap_eur_m=None,
            pe_ratio=rng.choice([None, 8.0, 30.0]), catalysts=["x"] * rng.randint(0, 3),
            risks=["r"] * rng.randint(0, 3),
        ))
        if rng.random() < 0.7:
            facts.append(dict(
                symbol=ticker + (".ST" if rows[-1]["country"] == "SE" else ".HE"),
                market_cap_eur_m=rng.choice([None, 100.0, 900.0]), price_to_book=rng.choice([None, 1.0, 6.0]),
                operating_margin_pct=rng.choice([-5.0, 5.0]), debt_to_equity=rng.choice([0.1, 2.0]),
            ))
    by_symbol = {f["symbol"]: f for f in facts}
    options = dict(limit=8, min_country_counts={"FI": 4}, countries=None)
    for strategy in ("balanced", "long-term"):
        got = watchlist(
            research(*rows), strategy, fundamentals=fundamentals_frame(spark, facts), enrichment_budget=6, **options
        ).orderBy("rank").collect()
        # First choice in plain score order, by hand.
        scored = strategy_scores(research(*rows), strategy).collect()
        best = {}
        for r in sorted(scored, key=lambda r: (-r.total, r.ticker)):
            best.setdefault(_key(r.name), r)
        ranked = [(r.ticker, r.country) for r in sorted(best.values(), key=lambda r: (-r.total, r.ticker))]
        chosen = [t for t, _ in greedy_quota(ranked, 8, {"FI": 4})][:6]
        enriched = []
        for row in rows:
            fact = by_symbol.get(row["ticker"] + (".ST" if row["country"] == "SE" else ".HE"))
            if row["ticker"] in chosen and fact:
                fills = {k: v for k, v in fact.items() if k != "symbol" and v is not None and row.get(k) is None}
                quality = "partial" if set(fills) & {*FILLABLE_METRICS, "market_cap_eur_m"} else "thin"
                row = {**row, **fills, "data_quality": quality}
            enriched.append(row)
        want = watchlist(research(*enriched), strategy, **options).orderBy("rank").collect()
        assert [(r["rank"], r.ticker, r.total, r.data_quality) for r in got] == [
            (r["rank"], r.ticker, r.total, r.data_quality) for r in want
        ], strategy
        assert sum(len(r.evidence) for r in got) > 0


def test_several_strategies_in_one_enriched_plan_equal_single_plans(spark, research):
    rows = [dict(ticker=f"T{i}", data_quality="thin", catalysts=["High live turnover"] * (i % 3 + 1),
                 pe_ratio=[None, 9.0][i % 2]) for i in range(30)]
    facts = fundamentals_frame(spark, [dict(symbol=f"T{i}.ST", price_to_book=1.0 + i % 2) for i in range(0, 30, 2)])
    options = dict(limit=5, fundamentals=facts, enrichment_budget=4)
    together = watchlist(research(*rows), ["trading", "long-term"], **options).collect()
    for strategy in ("trading", "long-term"):
        alone = watchlist(research(*rows), strategy, **options).collect()
        assert sorted((r["rank"], r.ticker, r.total) for r in alone) == sorted(
            (r["rank"], r.ticker, r.total) for r in together if r.strategy == strategy
        )


def test_enrichment_sorts_no_whole_rows(spark, monkeypatch):
    """Companies are compared by the columns of the order; whole rows are fetched for the few that are left."""
    plans, real = [], watchlist_plan.checkpointed

    def recorded(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return real(df)

    monkeypatch.setattr(watchlist_plan, "checkpointed", recorded)
    assert queries.watchlist_enriched(spark, SF).count() == 40
    by_company = [p for p in plans if "lead(" in p]
    assert by_company and not any("evidence#" in p for p in by_company)
