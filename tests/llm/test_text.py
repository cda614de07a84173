"""License scan, language ID, fingerprints, line dedup and mixing against plain versions."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.compare import connection, differences
from norrsken.llm import fingerprints as fp
from norrsken.llm import language as lg
from norrsken.llm import licenses as lc
from norrsken.llm import line_dedup as ld
from norrsken.llm import mixing as mx
from norrsken.llm.queries import ORACLES, QUERIES
from tests.llm.conftest import SF

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert not differences(spark, connection(SF), QUERIES[name], ORACLES[name], SF)


# License scan


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _plain_base(text):
    words = WORD.findall(_lower(text))
    places, labels = [], set()
    for phrase, label in lc.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def _distance_within(pattern, text):
    """Fewest edits between the pattern and any stretch of the text."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i - 1] + (p != c), row[i] + 1, new[-1] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_license_base(docs, corpus, odd, odd_rows):
    for frame, rows in ((docs, zip(corpus.doc_id, corpus.text)), (odd, [(r[0], r[1]) for r in odd_rows])):
        got = sorted(tuple(r)[:6] for r in lc.license_scan(frame).fillna({"doc_id": -1}).collect())
        assert repr(got) == repr(sorted((-1 if i is None or i != i else i, *_plain_base(t)) for i, t in rows))


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(lc.NOTICES)), st.lists(st.tuples(st.integers(0, 80), st.sampled_from(["x", " ", ""]), st.booleans()), max_size=6), st.text("abcd xyz", max_size=30))
def test_notices_found_within_edits(notice, edits, around):
    text = notice
    for at, letter, replaces in edits:
        at = min(at, len(text))
        text = text[:at] + letter + text[at + replaces:]
    text = f"{around} {text} {around}"
    joined = " " + " ".join(WORD.findall(text)) + " "
    got = {m[0] for m in lc.Notices().matches(joined)}
    want = {l for n, l in lc.NOTICES.items() if _distance_within(n, joined) <= len(n) // lc.CHARS_PER_EDIT}
    assert got == want


def test_license_spans():
    row = lc.scan("Released under the MTI license. See the Apache-License!", lc.Notices())
    assert row[4] == "apache" and "mit" in row[5].split(",") and row[6] == 1.0
    span = next(s for s in row[7] if s["label"] == "mit")
    joined = " ".join(WORD.findall("released under the mti license see the apache license"))
    assert joined[span["start"]:span["end"]].strip() == "released under the mti license" and span["edits"] == 2


def test_short_phrases_with_errors():
    for text, label in (("licensed under the MIT Licence", "mit"), ("the Apache Licence", "apache"), ("MIT Lisense.", "mit"),
                        ("an Apche License", "apache")):
        assert label in lc.scan(text, lc.Notices())[5].split(","), text
    for text in ("please omit license texts", "submit license", "the apache helicopter", "mit listens", "cc bye"):
        assert lc.scan(text, lc.Notices())[5] == "", text


def test_worse_match_before_a_better_one_is_found():
    text = " mozila public license mozilla public license "
    assert [m[3] for m in lc.Notices().matches(text)] == [1, 0]


@settings(max_examples=80, deadline=None)
@given(st.sampled_from(sorted(lc.NOTICES)), st.lists(st.lists(st.integers(0, 80), max_size=2), min_size=1, max_size=4),
       st.sampled_from([" ", " z ", " zzzz zz "]))
def test_every_copy_of_a_notice_is_found(notice, copies, between):
    text, places = " ", []
    for holes in copies:
        copy = list(notice)
        for at in holes[: len(notice) // lc.CHARS_PER_EDIT]:
            copy[at % len(copy)] = "q"
        places.append((len(text), len(text) + len(copy)))
        text += "".join(copy) + between
    spans = [m[1:3] for m in lc.Notices({notice: "x"}).matches(text)]
    assert all(any(a < end and start < b for a, b in spans) for start, end in places)
    assert len(spans) >= len(copies) and all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))
    for a, b in spans:
        assert _distance_within(notice, text[a:b]) <= len(notice) // lc.CHARS_PER_EDIT


@pytest.mark.parametrize("copy", ["all rights reservd ", "gnu genaral public license "])
def test_long_runs_of_a_notice(copy):
    began = time.perf_counter()
    found = lc.Notices().matches(" " + copy * 4000)
    assert time.perf_counter() - began < 5
    spans = sorted({m[1:3] for m in found})
    assert len(spans) >= 4000 and {m[3] for m in found} == {1}


# Language ID


def test_presence_is_that_of_plain_ngrams():
    text = "Ab bá"
    plain, want = f" {text.lower()} ", set()
    for at in range(len(plain)):
        code = 0
        for order in (1, 2, 3):
            if at + order > len(plain):
                break
            grown = ord(plain[at + order - 1]) + order
            code = ((code * 0x1000193 if order > 1 else 0) + grown) % 2**64
            want.add((code * 0x9E3779B97F4A7C15) % 2**64 >> 49)
    assert lg.presence(text).tolist() == sorted(want)


def test_regression_equals_plain_kernel_ridge():
    """With all rows as landmarks the Nyström map is exact, and the dual solution is the same function."""
    rng = np.random.default_rng(4)
    words = {c: ["".join(rng.choice(list(letters), 5)) for _ in range(40)]
             for c, letters in (("x", "abcdefg"), ("y", "efghijk"), ("z", "jklmnop"))}
    texts = [(" ".join(rng.choice(words[c], 12)), c) for c in "xyz" for _ in range(12)]
    sets = [set(lg.presence(t).tolist()) for t, _ in texts]
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    n = len(texts)
    centring = np.eye(n) - 1 / n
    y = np.array([[1.0 if c == name else -1.0 for name in "xyz"] for _, c in texts])
    dual = np.linalg.solve(centring @ kernel @ centring + lg.RIDGE * n * np.eye(n), y - y.mean(0))
    want = centring @ kernel @ centring @ dual + y.mean(0)
    model = lg.fit([lg.presence(t) for t, _ in texts], [c for _, c in texts])
    got = lg._unit_rows([lg.presence(t) for t, _ in texts]) @ model.weights + model.bias
    assert model.languages == ["x", "y", "z"] and np.abs(got - want).max() < 1e-3


def test_all_of_a_hundred_languages_are_learned(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(100):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrst"), 4)) for _ in range(12)]
        rows += [(1000 * k + i, " ".join(rng.choice(words, 30)), f"l{k:03}") for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    predicted = lg.languages(frame).join(frame.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in predicted if r.held_out]
    assert len({r.lang_pred for r in predicted}) == 100
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.9
    sampled = lg.training_sample(frame, most=250).groupBy("lang").count().collect()
    assert len(sampled) == 100 and {r["count"] for r in sampled} == {2}


def test_repeated_ids_are_learned_once(spark):
    rows = [(7, f"word{i} of one id", "en") for i in range(10_000)] + [(i, "other words here", "en") for i in range(8, 30)]
    rows += [(None, "no id", "en"), (7, "un mot", "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {i for i in range(7, 30) if zlib.crc32(str(i).encode()) % 5}
    got = sorted((r.lang, r.doc_id, r.text) for r in lg.training_sample(frame).collect())
    assert [(g, i) for g, i, _ in got] == sorted([("en", i) for i in want] + ([("fr", 7)] if 7 in want else []))
    assert got[0][2] == "word0 of one id" or 7 not in want


ALIEN = ["Ένα σύντομο κείμενο στα ελληνικά για δοκιμή του ταξινομητή", "Это короткий русский текст о погоде и новостях",
         "中文文本用于测试语言识别的拒绝", "Ένα σύντομο κείμενο στα ελληνικά. " * 500]


@pytest.mark.parametrize("languages", [2, 4, 40])
def test_unlearned_languages_are_rejected(spark, languages):
    """Whatever the number of languages; labels are split to have more of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    if languages == 2:
        docs = docs.where("lang in ('en', 'de')")
    elif languages == 40:
        docs = docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 10).cast("string")))
    strange = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(ALIEN)], docs.schema)
    kept = {r.doc_id for r in lg.in_known_language(docs.unionByName(strange)).select("doc_id").collect()}
    assert not kept & {10**9 + i for i in range(len(ALIEN))}
    assert len(kept) >= 0.998 * docs.count()


def test_known_language_keeps_any_columns(spark):
    frame = spark.createDataFrame(
        [(i, "the words of a plain text", "en", 5, {"a": i}, None) for i in range(9)] + [(9, None, None, 6, None, None)],
        "doc_id long, text string, lang string, `a.b` int, m map<string,int>, row struct<key:int>")
    kept = lg.in_known_language(frame)
    assert kept.columns == frame.columns and kept.dtypes == frame.dtypes
    assert sorted((r[0], r[3], r[4]["a"]) for r in kept.collect()) == [(i, 5, i) for i in range(9)]




def test_languages(spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lg.languages(big).join(big.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert lg.in_known_language(big).count() >= 0.99 * len(rows)


def test_languages_of_odd_rows(odd, none, odd_rows, spark):
    rows = lg.languages(odd).collect()
    assert len(rows) == len(odd_rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[7].lang_pred == by_id[2].lang_pred == by_id[3].lang_pred == "und"
    assert by_id[5].lang_pred != "und" and by_id[None].held_out is False
    assert lg.languages(none).count() == 0 and lg.in_known_language(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert lg.languages(unlabelled).first().lang_pred == "und"


# Fingerprints


def _plain_walk(text):
    """The embedding, one step at a time."""
    bits = (fp.splitmix(11, fp.CLASSES * fp.PERIOD) >> np.uint64(63)).astype(bool).reshape(fp.CLASSES, fp.PERIOD)
    read, at = [], 0
    while at < len(text):
        c = ord(text[at])
        step = len(read) % fp.PERIOD
        read.append(c)
        if bits[(c ^ (c >> 8)) % fp.CLASSES, step] or step == fp.PERIOD - 1:
            at += 1
    return read


def test_walk_against_plain():
    texts = ["", "a", "hello world é語😀", "abc" * 3000]
    walked = fp.Walked(texts)
    for i, text in enumerate(texts):
        read = _plain_walk(text)
        assert walked.ends[i] == len(read)
        again = [c for c, n in zip(text, np.diff([*walked.reached[i].tolist(), len(read)])) for _ in range(n)]
        assert [ord(c) for c in again] == read
        whole = fp._bytes(walked.points[i], walked.reached[i], len(read))
        if read:
            steps = fp._sampled(len(read))
            x = fp.mix64(np.array([read[s] for s in steps], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + steps.astype(np.uint64))
            assert whole == (x >> np.uint64(56)).astype(np.uint8).tobytes()


def _plain_edits(rows):
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for r, n in zip(ordered, [*ordered[1:], ordered[0]]):
        t, cut = r[1] or "", len(r[1] or "") // 3
        edited = t[:len(t) - cut] + (n[1] or "")[:cut]
        a, b, c = fp.fingerprints_of([t, edited, n[1] or ""])
        out[r[0]] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), fp.likeness(a, b), fp.likeness(a, c))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprint_rows(docs, corpus, parts):
    got = {r.doc_id: tuple(r)[1:7] for r in fp.fingerprints_with_edits(docs.repartition(parts)).collect()}
    assert got == _plain_edits(list(zip(corpus.doc_id, corpus.text)))
    edited, following = np.mean([r[4] for r in got.values()]), np.mean([r[5] for r in got.values()])
    assert edited > 0.6 and following < 0.3


def test_fingerprints_of_odd_rows(odd, none, odd_rows, spark):
    rows = fp.fingerprints_with_edits(odd).collect()
    assert len(rows) == len(odd_rows)
    prints = defaultdict(set)
    for r in rows:
        prints[r.doc_id].add(r.fingerprint)
    assert prints[5] == prints[6] and prints[9] == prints[10] and prints[2] == prints[3] == {"00" * fp.SLOTS}
    assert fp.fingerprints_with_edits(none).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert fp.fingerprints_with_edits(one).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_near_documents(spark):
    base = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(3000))
    rows = [(1, base), (2, base[:1500] + "Q" + base[1500:]), (3, base[::-1]), (4, base), (5, None)]
    got = {(r.doc_id, r.near_id) for r in fp.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (4, 1) in got and (2, 1) in got and not any(3 in p or 5 in p for p in got)


def test_near_documents_of_a_large_bucket(spark, monkeypatch):
    rng = np.random.default_rng(4)
    prints = [rng.integers(0, 256, fp.SLOTS, np.uint8) for _ in range(150)]
    for i in range(150):  # a near partner for each, at a likeness just above NEAR
        other = prints[i].copy()
        other[rng.choice(fp.SLOTS, 25, replace=False)] += 1
        prints.append(other)
    shared = [p.tobytes() for p in prints]
    monkeypatch.setattr(fp, "BLOCK", 64)
    monkeypatch.setattr(fp, "fingerprints", lambda *_: spark.createDataFrame(
        [(i, p, [7]) for i, p in enumerate(shared)], "doc_id long, fingerprint binary, bands array<long>"))
    got = {(r.doc_id, r.near_id): r.likeness for r in fp.near_documents(None).collect()}
    want = {(j, i): fp.likeness(shared[i], shared[j]) for j in range(300) for i in range(j) if fp.likeness(shared[i], shared[j]) >= fp.NEAR}
    assert got == want and len(want) == 150


def test_bands_recall_at_near():
    rng = np.random.default_rng(5)
    hits = 0
    for _ in range(600):
        a = rng.integers(0, 256, fp.SLOTS, np.uint8)
        b = a.copy()
        b[rng.choice(fp.SLOTS, 25, replace=False)] = rng.integers(0, 256, 25, np.uint8)
        hits += not set(fp.bands(a.tobytes())).isdisjoint(fp.bands(b.tobytes()))
    assert hits / 600 >= 0.95


# Line dedup


def _plain_lines(rows, least):
    sites, first = defaultdict(set), {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            line = line.strip(" \t\r")
            if line:
                sites[line] |= {site} - {None}
                first[line] = min(first.get(line, np.inf), np.inf if i is None else i)
    out = []
    for i, text, _ in rows:
        parts = text.split("\n") if text is not None else []
        kept = [p for p in parts if len(sites[p.strip(" \t\r")]) < least or first[p.strip(" \t\r")] == (np.inf if i is None else i)]
        out.append((i, len(parts), len(parts) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 3])
def test_line_dedup(spark, odd, odd_rows, least):
    rows = [(r[0], r[1], r[3]) for r in odd_rows]
    got = sorted((tuple(r) for r in ld.line_dedup(odd, min_sites=least).collect()), key=repr)
    assert got == _plain_lines(rows, least)
    many = [(n, f"top\nown {n}\r\n  top \n{'mid' if n % 3 else 'x'}", f"s{n % 7}") for n in range(60)]
    frame = spark.createDataFrame(many, "doc_id long, text string, source string")
    assert sorted((tuple(r) for r in ld.line_dedup(frame, min_sites=least).collect()), key=repr) == _plain_lines(many, least)


def test_near_threshold_is_exact(spark):
    rows = [(n, f"line {n // 40}", f"site {n % (9 + n // 40 % 3)}") for n in range(40 * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted((tuple(r) for r in ld.line_dedup(frame).collect()), key=repr) == _plain_lines(rows, ld.MIN_SITES)


def test_without_boilerplate(odd, none):
    kept = ld.without_boilerplate(odd, min_sites=2)
    assert kept.columns == odd.columns
    texts = {r.doc_id: r for r in kept.collect()}
    assert "shared line" in texts[1].text and texts[11].text == "licensed under the MIT License"
    assert texts[11].n_chars == 30 and 3 in texts and 2 in texts
    assert ld.without_boilerplate(none).count() == 0 and ld.line_dedup(none).count() == 0


# Mixing


def _plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * left >= 3 * sizes[s] * w}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * left / w for s in names}
        full |= over


def test_mix(docs, corpus, odd, none):
    for frame in (docs, odd):
        rows = mx.mixed(frame).collect()
        again = mx.mixed(frame.repartition(4)).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, again))
        source = {(r.doc_id): r.source for r in frame.collect()}
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        for r in rows:
            s = source[r.doc_id]
            sizes[s] += r.size
            taken[s] += r.taken
            target[s] = r.target
            assert 0 <= r.taken <= 3 * r.size
        want = _plain_targets(sizes)
        for s in sizes:
            assert target[s] == pytest.approx(want[s]) and taken[s] == int(target[s] + 1e-9)
    assert mx.mixed(none).count() == 0


def test_mixed_documents(docs, none):
    out = mx.mixed_documents(docs)
    assert out.columns == docs.columns
    words = re.compile("[^\x20\x09-\x0d]+")
    taken = {r.doc_id: r.taken for r in mx.mixed(docs).collect()}
    texts, got = {r.doc_id: r.text for r in docs.collect()}, defaultdict(int)
    for r in out.collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        got[r.doc_id] += len(words.findall(r.text))
    assert {d: n for d, n in taken.items() if n} == dict(got)
    assert mx.mixed_documents(none).count() == 0
