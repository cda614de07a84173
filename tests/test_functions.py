"""Column functions against Python's own rounding, formatting and dates."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from norrsken.functions import numeric as N
from norrsken.functions import text as T
from norrsken.functions.dates import add_weekdays, easter_sunday, iso_date

c = F.col


def column(spark, values, kind, **exprs):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return df.select("x", *(e.alias(n) for n, e in exprs.items())).collect()


def test_rounding_equals_python(spark):
    rng = random.Random(7)
    values = [1.005, 2.675, 1.115, 0.125, 0.135, -2.675, 35.57805, 0.0, 1e-9, 99999.995, -0.5]
    values += [rng.randint(-10**7, 10**7) / 1000 for _ in range(3000)]
    values += [rng.uniform(-1000, 1000) for _ in range(1000)]
    rows = column(spark, values, "double", one=N.round_dp(c("x"), 1), two=N.round_dp(c("x"), 2),
                  four=N.round_dp(c("x"), 4))
    for r in rows:
        assert (r.one, r.two, r.four) == (round(r.x, 1), round(r.x, 2), round(r.x, 4)), r.x


def test_compact_number_equals_python_g(spark):
    rng = random.Random(8)
    values = [0.0, 1.0, -1.0, 100.0, 2.675, 35.57805, 0.310944, 123456.5, 999999.4, 999999.6,
              1234567.0, 0.00012345, 0.0000123, 1e20, -5.5, 10.0, 0.1]
    values += [rng.randint(1, 10**8) / 10 ** rng.randint(0, 7) for _ in range(3000)]
    for r in column(spark, values, "double", g=N.compact_number(c("x"))):
        assert r.g == f"{r.x:g}", r.x


def test_fixed_and_percent_texts(spark):
    rows = column(spark, [0.05, -0.04, 2.25, -12.345, 100.0, 0.0, 16.125], "double",
                  one=N.fixed_text(c("x"), 1), signed=N.percent_text(c("x"), signed=True),
                  plain=N.percent_text(c("x")))
    for r in rows:
        assert r.one == f"{r.x:.1f}"
        text = f"{abs(r.x):.2f}".rstrip("0").rstrip(".")
        sign = "+" if r.x > 0 else "-" if r.x < 0 else ""
        assert r.signed == f"{sign}{text}%"
        assert r.plain == ("-" if r.x < 0 else "") + f"{text}%"


def test_market_numbers(spark):
    known = {"+6.25%": 6.25, "10,116,648": 10116648.0, " 34.90 ": 34.9, "": None, "n/a": None,
             "10d": None, "nan": None, "1e3": 1000.0, "-6.40%": -6.4, "%": None}
    rows = column(spark, [*known, None], "string", n=N.market_number(c("x")))
    assert {r.x: r.n for r in rows} == {**known, None: None}


def test_payload_numbers(spark):
    known = {"12.5": 12.5, '{"raw":7}': 7.0, '{"fmt":"7"}': None, "true": None, "abc": None,
             '{"raw":true}': None}
    rows = column(spark, list(known), "string", n=N.payload_number(c("x")))
    assert {r.x: r.n for r in rows} == known


def test_currency_rates_are_data(spark):
    rows = column(spark, ["EUR", "sek", "DKK", None], "string", r=N.eur_rate(c("x")),
                  own=N.eur_rate(c("x"), {"DKK": 0.13}))
    assert [(r.r, r.own) for r in rows] == [(1.0, None), (0.1, None), (None, 0.13), (None, None)]


def test_percent_or_ratio_and_finite(spark):
    rows = column(spark, [0.5, -1.0, 1.01, 37.0, float("inf"), float("nan")], "double",
                  p=N.as_percent(c("x")), f=N.finite(c("x")))
    assert [r.p for r in rows[:4]] == [50.0, -100.0, 1.01, 37.0]
    assert [r.f for r in rows] == [0.5, -1.0, 1.01, 37.0, None, None]


def test_segments_and_isin(spark):
    known = {"First North": "first_north", "first_north": "first_north", "FIRST-NORTH GM": "first_north",
             "Spotlight": "spotlight", "Main Market": "main_market", "otc": "other_public", None: "other_public"}
    rows = column(spark, list(known), "string", s=T.listing_segment(c("x")))
    assert {r.x: r.s for r in rows} == known
    rows = column(spark, [" se001", "FI4", "DK1", ""], "string", s=T.isin_country(c("x")))
    assert [r.s for r in rows] == ["SE", "FI", "", ""]


def _key(name):
    import re

    words = re.sub(r"[^a-z0-9]+", " ", name.lower()).split()
    drop = "ab ag corp corporation inc limited ltd oy oyj plc publ a b".split()
    while words and words[-1] in drop:
        words.pop()
    return " ".join(words)


def test_company_key_equals_word_by_word_stripping(spark):
    rng = random.Random(3)
    words = "ab a b oyj publ volvo acme a1 inc öst group ltd. (publ)".split()
    names = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    names += ["AB", "A B", "Volvo AB ser. B", "ABB Ltd", "Kabe Group AB B", "Oy B Ab"]
    rows = column(spark, names, "string", k=T.company_key(c("x"), F.lit("T|SE")))
    for r in rows:
        assert r.k == (_key(r.x) or "T|SE"), r.x


def test_pick_company_key_uses_ticker_only_without_name(spark):
    rows = column(spark, ["AB", "", None, "Acme B"], "string", k=T.pick_company_key(c("x"), F.lit(" abc ")))
    assert [r.k for r in rows] == ["", "ABC", "ABC", "acme"]


def test_symbol_candidates(spark):
    df = spark.createDataFrame(
        [(" volv b ", "SE"), ("NOKIA", "FI"), ("MAERSK", "DK"), ("A-B C", "fi")], "t string, c string"
    )
    rows = df.select(T.symbol_candidates(c("t"), c("c")).alias("s")).collect()
    assert [r.s for r in rows] == [
        ["VOLV-B.ST", "VOLVB.ST"], ["NOKIA.HE"], [], ["A-B-C.HE", "ABC.HE"]
    ]


def test_dedupe_texts_keeps_first_spelling(spark):
    rows = column(spark, [["Net cash", " net CASH ", "b", "B ", "a"], []], "array<string>",
                  d=T.distinct_texts(c("x"), T.text_keys(c("x"))))
    assert [r.d for r in rows] == [["Net cash", "b", "a"], []]


def test_public_wording(spark):
    risks = ["Sparse live-source data", "thin data quality", "2 stated risk(s)", " low cash ",
             "trading strategy adjustment applied", "missing live turnover", ""]
    rows = column(spark, [risks], "array<string>", p=T.public_risks(c("x")))
    assert rows[0].p == ["Low cash"]
    rows = column(spark, [["low P/B", "discovery strategy adjustment applied", "momentum strategy adjustment applied"]],
                  "array<string>", p=T.public_reasons(c("x")))
    assert rows[0].p == ["Low P/B", "Discovery strategy boost: smaller or less-covered listing profile.",
                         "Momentum strategy adjustment applied"]


def test_signal_labels(spark):
    known = {
        "gate:Speculative monitor": "Gate: Speculative monitor",
        "gate_durable_anchors:3": "Gate durable anchors: 3",
        "valuation_proxy:market_cap_to_sales": "Valuation proxy: Market cap to sales",
        "quality_bucket:Insufficient evidence": "Bucket: Insufficient evidence",
        "proof_gap:thin liquidity": "Proof gap: Thin liquidity",
        "reason:low P/E (11.2)": "Reason: Low P/E (11.2)",
        "segment:main_market": "Segment: Main market",
        "reason:note: second": "Reason: Note: second",
        "other:x": "Other: X",
    }
    rows = column(spark, list(known), "string", s=T.signal_label(c("x")))
    assert {r.x: r.s for r in rows} == known


def test_clean_text(spark):
    rows = column(spark, ["  a\n b\t c ", " \n ", None], "string", s=T.clean_text(c("x")))
    assert [r.s for r in rows] == ["a b c", None, None]


def test_weekday_addition_equals_a_day_loop(spark):
    start = dt.date(2026, 5, 1)
    days = [start + dt.timedelta(days=i) for i in range(14)]
    df = spark.createDataFrame([(d,) for d in days], "d date").select(
        "d", F.explode(F.array(*(F.lit(n) for n in (1, 2, 5, 20, 60)))).alias("n")
    )
    for r in df.withColumn("due", add_weekdays(c("d"), c("n"))).collect():
        day, left = r.d, r.n
        while left:
            day += dt.timedelta(days=1)
            left -= day.weekday() < 5
        assert r.due == day


def test_easter(spark):
    known = {1961: (4, 2), 2000: (4, 23), 2008: (3, 23), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25)}
    rows = column(spark, list(known), "int", e=easter_sunday(c("x")))
    assert {r.x: (r.e.month, r.e.day) for r in rows} == known


def test_iso_dates(spark):
    rows = column(spark, ["2026-05-11", "11.5.2026", None], "string", d=iso_date(c("x")))
    assert [r.d for r in rows] == [dt.date(2026, 5, 11), None, None]
