"""Snapshots, outcome states, benchmark, the ledger folder."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from norrsken.operators import outcomes as oc
from norrsken.schemas import SNAPSHOTS
from norrsken.sources.ledger import Ledger, merge_picks

DAY = dt.date(2026, 5, 11)  # a Monday


def day(n: int) -> dt.date:
    return DAY + dt.timedelta(days=n)


def quotes(spark, *rows):
    return spark.createDataFrame(
        [(t, k, p, cur) for t, k, p, cur in rows], "ticker string, country string, price double, currency string"
    ).withColumns({n: F.lit(None).cast("string") for n in ("name", "segment", "sector")}
                  | {n: F.array().cast("array<string>") for n in ("catalysts", "risks")})


def snapshots(spark, *rows):
    return spark.createDataFrame(
        [dict.fromkeys(SNAPSHOTS.names) | dict(snapshot_date=d, ticker=t, country=k, price=p, currency=cur)
         for d, t, k, p, cur in rows], SNAPSHOTS)


def test_snapshot_drops_rows_without_price_or_currency(spark):
    df = oc.market_snapshot(quotes(spark, ("a", "se", 1.0, "SEK"), ("b", "se", None, "SEK"), ("c", "se", 1.0, None)), DAY)
    assert [(r.ticker, r.country, r.snapshot_date) for r in df.collect()] == [("A", "SE", DAY)]


def test_due_dates_follow_weekdays(spark, picks_frame):
    rows = oc.open_outcomes(picks_frame(dict(report_date=dt.date(2026, 5, 15)))).collect()
    assert {r.horizon: r.due_date for r in rows}["1d"] == dt.date(2026, 5, 18)
    assert len(rows) == 4 and {r.status for r in rows} == {"not_due"}


def run(spark, picks, outcomes, snaps, as_of, *day_quotes):
    dated = quotes(spark, *day_quotes) if day_quotes else quotes(spark, ("Z", "SE", 1.0, "SEK")).where("false")
    return oc.update_due(outcomes, picks, dated.withColumn("quote_date", F.lit(as_of)), snaps, as_of)


def by_horizon(df):
    return {r.horizon: r for r in df.collect()}


def test_due_horizons_are_priced_and_later_ones_stay_open(spark, picks_frame):
    picks = picks_frame(dict(report_date=DAY))
    snaps = snapshots(spark).where("false") if False else spark.createDataFrame([], SNAPSHOTS)
    first = run(spark, picks, oc.open_outcomes(picks), snaps, day(1), ("STABL", "SE", 1.02, "SEK"))
    rows = by_horizon(run(spark, picks, first, snaps, day(7), ("STABL", "SE", 1.10, "SEK")))
    assert (rows["1d"].status, rows["1d"].return_pct, rows["1d"].as_of_date) == ("priced", 20.0, day(1))
    assert (rows["5d"].status, rows["5d"].return_pct) == ("priced", 29.41)
    assert rows["20d"].status == "not_due" and rows["1d"].benchmark_label is None


def test_missed_missing_and_final_states(spark, picks_frame):
    picks = picks_frame(dict(report_date=DAY), dict(report_date=DAY, ticker="EUR", entry_currency="EUR"),
                        dict(report_date=DAY, ticker="ZERO", entry_price=0.0))
    snaps = spark.createDataFrame([], SNAPSHOTS)
    on_day = run(spark, picks, oc.open_outcomes(picks), snaps, day(1), ("EUR", "SE", 2.0, "SEK"), ("ZERO", "SE", 3.0, "SEK"))
    rows = {(r.pick_id.split("|")[3], r.horizon): r for r in on_day.collect()}
    assert {k: r.status for k, r in rows.items() if k[1] == "1d"} == {
        ("STABL", "1d"): "missing_price", ("EUR", "1d"): "missing_price", ("ZERO", "1d"): "missing_price"}
    assert rows[("EUR", "1d")].price == 2.0 and rows[("EUR", "1d")].currency == "SEK"
    assert rows[("STABL", "1d")].price is None
    # Final states do not change, and a run after the due date finds a missed window.
    later = run(spark, picks, on_day, snaps, day(8), ("STABL", "SE", 1.02, "SEK"))
    rows = {(r.pick_id.split("|")[3], r.horizon): r for r in later.collect()}
    assert rows[("STABL", "1d")].status == "missing_price" and rows[("STABL", "1d")].as_of_date == day(1)
    assert rows[("STABL", "5d")].status == "missed_window" and rows[("STABL", "5d")].price is None


def test_benchmark_and_excess(spark, picks_frame):
    picks = picks_frame(dict(report_date=DAY, entry_price=10.0))
    prices = {"STABL": 12.0, "PEER": 11.0, "LOSS": 9.0}
    snaps = snapshots(
        spark, *((DAY, t, "SE", 10.0, "SEK") for t in prices), *((day(1), t, "SE", p, "SEK") for t, p in prices.items()),
        (DAY, "FIN", "FI", 1.0, "EUR"), (day(1), "FIN", "FI", 9.0, "EUR"), (DAY, "CUR", "SE", 1.0, "SEK"),
        (day(1), "CUR", "SE", 9.0, "EUR"), (DAY, "NIL", "SE", 0.0, "SEK"), (day(1), "NIL", "SE", 9.0, "SEK"),
    )
    row = by_horizon(run(spark, picks, oc.open_outcomes(picks), snaps, day(1), ("STABL", "SE", 12.0, "SEK")))["1d"]
    assert (row.return_pct, row.benchmark_return_pct, row.excess_return_pct) == (20.0, 6.67, 13.33)
    assert row.benchmark_label == "Equal-weight SE market"


def test_history_equals_one_run_after_the_other(spark, picks_frame):
    picks = picks_frame(*(dict(report_date=day(n), ticker=f"T{n % 3}", entry_price=2.0 + n) for n in range(0, 12)),
                        dict(report_date=day(-20), ticker="T1"))
    days = [day(n) for n in range(0, 26) if n not in (4, 9) and day(n).weekday() < 6]
    rows = [(d, f"T{i}", "SE", 3.0 + i + d.day / 7, "SEK" if (d.day + i) % 5 else "EUR") for d in days for i in range(3)
            if not (i == 2 and d.day % 4 == 0)]
    snaps = snapshots(spark, *rows)
    runs = spark.createDataFrame([(d,) for d in days], "run_date date")
    dated = snaps.withColumnRenamed("snapshot_date", "quote_date")
    once = oc.evaluate_history(picks, dated, snaps, runs)
    names = ["pick_id", "horizon", "status", "as_of_date", "price", "return_pct", "benchmark_return_pct", "excess_return_pct"]
    got = {tuple(r)[:2]: tuple(r)[2:] for r in once.select(*names).collect()}
    # The same, run by run, in Python.
    price = {(d, t): (p, cur) for d, t, _, p, cur in rows}
    for p in picks.collect():
        for horizon, n in (("1d", 1), ("5d", 5), ("20d", 20), ("60d", 60)):
            due, left = p.report_date, n
            while left:
                due += dt.timedelta(days=1)
                left -= due.weekday() < 5
            status, as_of = "not_due", None
            for d in days:
                if d >= due:
                    as_of = d
                    quote = price.get((d, p.ticker))
                    status = ("missed_window" if d > due else "missing_price" if not quote or quote[1] != "SEK" else "priced")
                    break
            assert got[(p.pick_id, horizon)][:2] == (status, as_of), (p.pick_id, horizon)
            if status == "priced":
                peers = [(price[(due, t)][0] - v) / v * 100 for (d, t), (v, cur) in price.items()
                         if d == p.report_date and (due, t) in price and price[(due, t)][1] == cur]
                want = round((price[(due, p.ticker)][0] - p.entry_price) / p.entry_price * 100, 2)
                bench = round(sum(peers) / len(peers), 2) if peers else None
                excess = None if bench is None else round(want - bench, 2)
                assert got[(p.pick_id, horizon)][3:] == (want, bench, excess)


def test_upsert_keeps_entry_of_priced_picks_only(spark, picks_frame):
    old = picks_frame(*(dict(report_date=DAY, ticker=t, entry_price=1.0, rank=9, entry_timestamp="old") for t in "ABC"))
    new = picks_frame(*(dict(report_date=DAY, ticker=t, entry_price=2.0, rank=4, entry_timestamp="new") for t in "ABD"))
    priced = old.where("ticker = 'A'").select("report_date", "pick_id")
    rows = {r.ticker: r for r in merge_picks(old, new, priced).collect()}
    assert {t: (r.entry_price, r["rank"], r.entry_timestamp) for t, r in rows.items()} == {
        "A": (1.0, 4, "old"), "B": (2.0, 4, "new"), "C": (1.0, 9, "old"), "D": (2.0, 4, "new")}


def test_ledger_folder(spark, picks_frame, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.table("picks").count() == 0
    picks = picks_frame(dict(report_date=DAY), dict(report_date=day(1), ticker="LATE"))
    ledger.update(picks, quotes(spark, ("STABL", "SE", 0.85, "SEK"), ("NOPRICE", "SE", None, "SEK")), DAY)
    ledger.update(picks.where("ticker = 'STABL'"), quotes(spark, ("STABL", "SE", 1.02, "SEK")), day(1))
    # Same-day rerun: the snapshot is replaced, the priced entry stays, nothing doubles.
    again = picks_frame(dict(report_date=DAY, entry_price=99.0, score_total=5.0))
    ledger.update(again, quotes(spark, ("STABL", "SE", 1.02, "SEK"), ("NEW", "SE", 1.0, "SEK")), day(1))
    ledger.update(again, None, day(7))
    rows = {r.pick_id: r for r in ledger.table("picks").collect()}
    assert len(rows) == 2 and rows["2026-05-11|trading|SE|STABL"].entry_price == 0.85
    assert rows["2026-05-11|trading|SE|STABL"].score_total == 5.0
    status = {(r.pick_id[-5:], r.horizon): (r.status, r.return_pct) for r in ledger.table("outcomes").collect()}
    assert len(status) == 8 and status[("STABL", "1d")] == ("priced", 20.0)
    assert status[("STABL", "5d")] == ("not_due", None)
    held = {(r.snapshot_date, r.ticker) for r in ledger.table("snapshots").collect()}
    assert held == {(DAY, "STABL"), (day(1), "STABL"), (day(1), "NEW")}
    assert ledger.outcomes_with_picks().count() == 8


def test_other_ledger_versions_are_refused(spark, picks_frame, tmp_path):
    path = str(tmp_path / "ledger")
    picks_frame(dict(report_date=DAY)).withColumn("schema_version", F.lit(2)).write.partitionBy("report_date").parquet(f"{path}/picks")
    with pytest.raises(Exception, match="unsupported performance ledger schema: 2"):
        Ledger(spark, path).table("picks").collect()
