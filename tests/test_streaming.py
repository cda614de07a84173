"""Streams against the batch results on the same rows."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from norrsken.operators import outcomes as oc
from norrsken.operators.scorecard import daily_market_context, horizon_scorecard, scorecard_of
from norrsken.plans import queries as q
from norrsken.plans.summary import ledger_summary, write_summary
from norrsken.sources import testtables as tt
from norrsken.sources.ledger import ConcurrentRun, Ledger, read_ledger
from norrsken.streaming.ledger_updates import report_stream, stream_ledger_update
from norrsken.streaming.market_context import read_context, start_context_sink, stream_market_context
from tests.conftest import SF

QUOTE = "ts timestamp, ticker string, country string, price double, currency string, catalysts array<string>, risks array<string>"


def quote(day, hour, ticker, price=1.0, mover=False, selloff=False):
    return (dt.datetime(2026, 5, day, hour), ticker, "SE", price, "SEK",
            ["Strong intraday momentum (+12%)"] if mover else [], ["Sharp intraday selloff"] if selloff else [])


def test_context_stream_takes_the_last_quote_of_closed_days(spark, tmp_path):
    landing, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))

    def land(*rows):
        spark.createDataFrame(rows, QUOTE).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(QUOTE).parquet(landing)
        start_context_sink(stream_market_context(stream), out, progress).awaitTermination()
        every = {str(r.snapshot_date): r for r in read_context(spark, out).collect()}
        return every, {d: r for d, r in every.items() if r.closed}

    first = (quote(11, 8, "A", mover=True), quote(11, 9, "B", mover=True), quote(11, 9, "C", price=None), quote(11, 10, "A"))
    every, rows = land(*first)
    # The open day is visible, and replaced by every batch; B moves, A does not any more, C has no price.
    assert not rows and (every["2026-05-11"].companies, every["2026-05-11"].positive_movers) == (2, 1)
    # Late but inside the allowed day: A moves again. Day 11 closes when day 13 arrives.
    late = (quote(12, 9, "A", selloff=True), quote(12, 9, "B", selloff=True), quote(11, 18, "A", mover=True))
    land(*late)
    every, rows = land(quote(13, 9, "A"))
    assert set(rows) == {"2026-05-11"} and set(every) == {"2026-05-11", "2026-05-12", "2026-05-13"}
    # A quote of a closed day changes nothing, and an empty last quote takes a company out.
    every, rows = land(quote(15, 9, "A"), quote(15, 9, "B"), quote(15, 10, "B", price=None), quote(11, 23, "D", mover=True))
    assert set(rows) == {"2026-05-11", "2026-05-12", "2026-05-13"} and every["2026-05-15"].companies == 1
    assert (rows["2026-05-11"].companies, rows["2026-05-11"].positive_movers) == (2, 2)
    assert rows["2026-05-11"].tone == "Risk-on / broad momentum"
    assert rows["2026-05-12"].tone == "Risk-off / broad selloff"
    # The batch form over the last quotes gives the same.
    quotes = spark.createDataFrame(first + late, QUOTE).where("price is not null")
    last = quotes.groupBy(F.col("ts").cast("date").alias("snapshot_date"), "ticker").agg(
        F.max_by("catalysts", "ts").alias("catalysts"), F.max_by("risks", "ts").alias("risks"))
    for r in daily_market_context(last).collect():
        assert rows[str(r.snapshot_date)].positive_movers == r.positive_movers
        assert rows[str(r.snapshot_date)].companies == r.companies


def test_stream_reads_reports_on_many_lines(spark, tmp_path):
    item = dict(rank=1, company=dict(ticker="a", country="se"), score=dict(total=1.0), financials=dict(price=2.0, currency="SEK"))
    for day, strategy in (("2026-05-11", "trading"), ("2026-05-12", "balanced")):
        folder = tmp_path / "in" / f"report_date={day}"
        folder.mkdir(parents=True)
        (folder / "r.json").write_text(json.dumps(dict(metadata=dict(strategy=strategy), items=[item]), indent=2))
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    stream_ledger_update(report_stream(spark, str(tmp_path / "in")), ledger, str(tmp_path / "p")).awaitTermination()
    assert [r.pick_id for r in ledger.table("picks").collect()] == ["2026-05-11|trading|SE|A"]
    rejected = spark.read.parquet(f"{ledger.path}/rejected").collect()
    assert [(r.strategy, r.reason) for r in rejected] == [("balanced", "strategy without picks")]


def test_empty_day_replaces_its_snapshot(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    day = dt.date(2026, 5, 11)
    schema = "ticker string, country string, price double, currency string, name string, segment string, sector string, catalysts array<string>, risks array<string>"
    quotes = spark.createDataFrame([("A", "SE", 1.0, "SEK", "A", "m", "s", [], [])], schema)
    ledger.record_snapshot(quotes, day)
    ledger.record_snapshot(quotes, dt.date(2026, 5, 12))
    assert ledger.table("snapshots").count() == 2
    ledger.record_snapshot(quotes.where("false"), day)
    assert [r.snapshot_date for r in ledger.table("snapshots").collect()] == [dt.date(2026, 5, 12)]


def test_ledger_stream_is_idempotent(spark, tmp_path):
    reports = str(tmp_path / "reports")
    q._write_reports(spark, SF, reports)
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    stream_ledger_update(report_stream(spark, reports), ledger, str(tmp_path / "p1")).awaitTermination()
    want = {r.pick_id: r.entry_price for r in tt.picks(spark, SF).collect()}
    assert {r.pick_id: r.entry_price for r in ledger.table("picks").collect()} == want
    # A replay with lost progress changes nothing.
    stream_ledger_update(report_stream(spark, reports), ledger, str(tmp_path / "p2")).awaitTermination()
    assert {r.pick_id: r.entry_price for r in ledger.table("picks").collect()} == want
    assert ledger.table("outcomes").count() == 4 * len(want)


def test_streamed_days_equal_the_batch(spark):
    """All days of the table, the newest two included."""
    rows = {r.snapshot_date: r for r in q.stream_context(spark, SF).collect()}
    last = tt.table(spark, SF, "events").where("user_id % 50 <> 7").groupBy(
        F.col("ts").cast("date").alias("day"), "user_id").agg(F.max_by("event_type", "ts").alias("kind"))
    want = {str(r.day): r for r in last.groupBy("day").agg(
        F.count("*").alias("n"), F.count_if(F.col("kind") == "purchase").alias("movers")).collect()}
    assert {d: (r.companies, r.positive_movers) for d, r in rows.items()} == {d: (r.n, r.movers) for d, r in want.items()}


def _land_days(spark, folder, picks, quotes, days):
    for day in days:
        for p in [p for p in picks if p["report_date"] == day]:
            item = dict(rank=1, company=dict(ticker=p["ticker"], country="SE", name="N"), score=dict(total=1.0),
                        financials=dict(price=p["entry_price"], currency="SEK"))
            place = folder / "reports" / f"report_date={day}"
            place.mkdir(parents=True, exist_ok=True)
            (place / f"{p['ticker']}.json").write_text(json.dumps(dict(metadata=dict(strategy="trading"), items=[item])))
    rows = [x for x in quotes if x[0] in days]
    if rows:
        spark.createDataFrame(rows, DAILY).coalesce(1).write.mode("append").parquet(str(folder / "quotes"))


DAILY = "quote_date date, ticker string, country string, price double, currency string"


def test_stream_settles_like_the_history(spark, picks_frame, tmp_path):
    """Batches of several days, a day without run, a replayed batch: the same outcomes as over the whole history."""
    first = dt.date(2026, 5, 11)
    days = [first + dt.timedelta(n) for n in range(12)]
    picks = [dict(report_date=d, ticker=f"T{n % 3}", entry_price=2.0 + n, entry_currency="SEK") for n, d in enumerate(days) if d.weekday() < 5]
    run_days = [d for d in days if d.weekday() < 5 and d != days[3]]
    quotes = [(d, f"T{i}", "SE", 3.0 + i + d.day / 7, "SEK" if (d.day + i) % 5 else "EUR") for d in run_days for i in range(3)]
    more = {n: F.lit(None).cast("string") for n in ("name", "segment", "sector")} | {
        n: F.array().cast("array<string>") for n in ("catalysts", "risks")}
    ledger = Ledger(spark, str(tmp_path / "ledger"))

    def run(progress="p"):
        stream = spark.readStream.schema(DAILY).parquet(str(tmp_path / "quotes")).withColumns(more)
        stream_ledger_update(report_stream(spark, str(tmp_path / "reports")), ledger, str(tmp_path / progress),
                             quotes=stream).awaitTermination()

    for part in (days[:4], days[4:5], days[5:]):
        _land_days(spark, tmp_path, picks, quotes, part)
        run()
    assert len(ledger.versions()) == 3
    frame = spark.createDataFrame(quotes, DAILY).withColumns(more)
    once = oc.evaluate_history(
        picks_frame(*picks), frame, oc.market_snapshot(frame.withColumnRenamed("quote_date", "snapshot_date")),
        spark.createDataFrame([(d,) for d in run_days], "run_date date"))
    names = ["pick_id", "horizon", "status", "price", "return_pct", "benchmark_return_pct", "excess_return_pct"]
    key = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    want = key(once.select(*names).collect())
    assert key(ledger.table("outcomes").select(*names).collect()) == want
    assert {r.status for r in ledger.table("outcomes").collect()} == {"priced", "missing_price", "missed_window", "not_due"}
    # The state of the scorecard adds up to the scorecard of all outcomes.
    assert sorted(map(tuple, scorecard_of(ledger.table("tallies")).collect()), key=repr) == sorted(
        map(tuple, horizon_scorecard(ledger.outcomes_with_picks()).collect()), key=repr)
    # A batch that the manifest holds already is skipped, whatever it brings.
    held = ledger.manifest()
    (name, number), = held.applied.items()
    assert not ledger.update_days(picks_frame(dict(report_date=first, ticker="NEW")), None, applied=(name, number))
    assert ledger.manifest() == held


def test_failed_run_leaves_the_old_state_whole(spark, picks_frame, tmp_path, monkeypatch):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    day = dt.date(2026, 5, 11)
    schema = "ticker string, country string, price double, currency string, name string, segment string, sector string, catalysts array<string>, risks array<string>"
    quotes = spark.createDataFrame([("STABL", "SE", 1.0, "SEK", "A", "m", "s", [], [])], schema)
    ledger.update(picks_frame(dict(report_date=day)), quotes, day)

    def state(version=None):
        return {n: sorted(map(repr, df.collect())) for n, df in read_ledger(spark, ledger.path, version).items()}

    before, next_day = state(), day + dt.timedelta(1)
    for step in ("_settle", "_publish"):
        with monkeypatch.context() as broken:
            broken.setattr(Ledger, step, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError, match="lost"):
                ledger.update(picks_frame(dict(report_date=next_day, ticker="NEW")), quotes, next_day)
        assert state() == before and ledger.versions() == [1]
    ledger.update(picks_frame(dict(report_date=next_day, ticker="NEW")), quotes, next_day)
    after = state()
    assert len(after["picks"]) == 2 and len(after["snapshots"]) == 2 and any("priced" in r for r in after["outcomes"])
    # A reader that is pinned to the first version still reads it; writing through it is refused.
    assert state(1) == before
    with pytest.raises(ValueError, match="read only"):
        Ledger(spark, ledger.path, 1).add_picks(picks_frame(dict(report_date=day)))
    # Two runs from one state: the second cannot publish.
    draft, _ = ledger._begin()
    ledger.record_snapshot(quotes, next_day)
    with pytest.raises(ConcurrentRun):
        ledger._publish(draft)
    # Files without a manifest go; the newest state stays.
    newest = state()
    ledger.forget(keep=1)
    assert ledger.versions() == [3] and state() == newest
    runs = {r for days in ledger.manifest().tables["picks"].values() for r in days}
    assert {p.name for p in (tmp_path / "ledger" / "data" / "picks").iterdir() if p.is_dir()} == {f"run={r}" for r in runs}


def test_first_layout_is_taken_over(spark, picks_frame, tmp_path):
    path, day = str(tmp_path / "ledger"), dt.date(2026, 5, 11)
    picks = picks_frame(dict(report_date=day), dict(report_date=day, ticker="B"))
    picks.withColumn("schema_version", F.lit(1)).write.partitionBy("report_date").parquet(f"{path}/picks")
    oc.open_outcomes(picks).withColumn("schema_version", F.lit(1)).write.partitionBy("due_date").parquet(f"{path}/outcomes")
    ledger = Ledger(spark, path)
    assert ledger.table("picks").count() == 2 and ledger.table("outcomes").count() == 8
    ledger.add_picks(picks_frame(dict(report_date=day, ticker="C")))
    assert ledger.table("picks").count() == 3 and ledger.table("outcomes").count() == 12


def test_summary_frames_are_written(spark, picks_frame, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    day = dt.date(2026, 5, 11)
    schema = "ticker string, country string, price double, currency string, name string, segment string, sector string, catalysts array<string>, risks array<string>"
    for n, price in enumerate((1.0, 1.2)):
        quotes = spark.createDataFrame([("STABL", "SE", price, "SEK", "A", "m", "s", [], [])], schema)
        ledger.update(picks_frame(dict(report_date=day, entry_price=1.0)), quotes, day + dt.timedelta(n))
    write_summary(ledger_summary(ledger), str(tmp_path / "out"), "json")
    read = {n: spark.read.json(str(tmp_path / "out" / n)) for n in ("horizons", "signals", "context", "ranked", "latest")}
    one = read["horizons"].where("strategy = 'trading' and horizon = '1d'").first()
    assert (one.completed, one.average_return_pct, one.hit_rate_pct) == (1, 20.0, 100.0)
    assert read["horizons"].count() == 8 and read["latest"].first().latest_return_pct == 20.0
    assert read["context"].first().companies == 1 and {r.list for r in read["ranked"].collect()} == {"best"}


def test_joins_of_written_tables_broadcast_no_rows(spark, picks_frame, tmp_path):
    """A table's size on disk says little of its size in memory: only days and spans are broadcast."""
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    day = dt.date(2026, 5, 11)
    ledger.add_picks(picks_frame(dict(report_date=day)))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" not in plan(ledger.outcomes_with_picks())
    written = {}
    due = spark.range(9).selectExpr("concat('T', id) ticker", "'SE' country", "date'2026-05-11' report_date", "date'2026-05-12' due_date",
                                    "date'2026-05-12' as_of_date", "2.0D entry_price", "'SEK' entry_currency")
    quotes = spark.range(9).selectExpr("concat('T', id) ticker", "'SE' country", "date'2026-05-12' quote_date", "3.0D price", "'SEK' currency")
    snaps = quotes.withColumnRenamed("quote_date", "snapshot_date")
    for name, df in dict(due=due, quotes=quotes, snaps=snaps.unionByName(snaps.withColumn("snapshot_date", F.lit(day)))).items():
        df.write.parquet(str(tmp_path / name))
        written[name] = spark.read.parquet(str(tmp_path / name))
    settled = oc.settle(written["due"], written["quotes"], written["snaps"])
    assert {(r.return_pct, r.excess_return_pct) for r in settled.collect()} == {(50.0, 50.0)}
    # The benchmark's three keys and its spans' two are what may be broadcast; quotes and rows are sorted.
    joins = [x for x in plan(settled).splitlines() if "HashJoin" in x]
    assert joins and not any("ticker" in x for x in joins), joins
    assert sum("SortMergeJoin" in x for x in plan(settled).splitlines()) >= 2


def test_report_files_hold_few_documents(spark, tmp_path):
    q._write_reports(spark, SF, str(tmp_path / "reports"), block=1, per_file=2)
    files = [f.read_text().splitlines() for f in (tmp_path / "reports").rglob("*.json")]
    assert max(map(len, files)) == 2 and sum(map(len, files)) == tt.picks(spark, SF).count()


def test_picks_read_events_once(spark):
    assert tt.picks(spark, SF)._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1
