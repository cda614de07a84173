"""Merkle manifest, ranked search and decontamination against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from checks.compare import connection, differences
from norrsken.llm import decontaminate, merkle, search
from norrsken.llm.words import words_of
from tests.llm.conftest import SF

ITEMS = "item_id long, text string, score string, _q int"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_ranked_search", "op13_decontamination"])
def test_query_equals_sql(spark, name):
    assert not differences(spark, connection(SF), queries()[name], oracle_sql()[name], SF)


# Merkle manifest ---------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, columns):
    texts = [None if row[c] is None else str(row[c]) for c in columns]
    return digest(*["-" if t is None else f"{len(t.encode())}:{t}" for t in texts])


def tree(nodes):
    """Root, and for each node its siblings (left, right) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(at):
            run = nodes[place - place % 3:place - place % 3 + 3]
            paths[k].append(("".join(run[:place % 3]), "".join(run[place % 3 + 1:])))
        nodes = [digest(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        at = [p // 3 for p in at]
    return nodes[0], paths


def plain_manifest(rows, columns):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        held = sorted(((r["doc_id"], leaf(r, columns)) for r in by_source[s]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = held, *tree([x for _, x in held])
    root, across = tree([trees[s][1] for s in order])
    return sorted(
        ((d, x, trees[s][1], root, tuple(path + across[k])) for k, s in enumerate(order)
         for (d, x), path in zip(trees[s][0], trees[s][2])), key=repr)


def found_manifest(df, columns):
    rows = merkle.manifest(df, columns).collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.steps)) for r in rows), key=repr)


def test_manifest_of_odd_rows(spark, odd, none):
    columns = ["doc_id", "text", "lang", "row", "bucket"]
    assert found_manifest(odd, columns) == plain_manifest([r.asDict() for r in odd.collect()], columns)
    assert found_manifest(none, columns) == []
    one = odd.where("doc_id = 1")
    assert found_manifest(one, columns)[0][4] == ()


@pytest.mark.parametrize("levels", [1, 2])
def test_manifest_over_many_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "ROWS_PER_PART", 7)
    sizes = {"a": 1, "b": 2, "c": 3, "d": 4, "e": 9, "f": 10, "g": 27, "h": 28, "i": 100, None: 5, "": 3}
    rows = [(n if n % 5 else 7, s) for s, size in sizes.items() for n in range(size)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string")
    assert found_manifest(df, ["doc_id", "source"]) == plain_manifest(
        [dict(doc_id=d, source=s) for d, s in rows], ["doc_id", "source"])


def test_tampering_is_found(spark):
    rows = {r.doc_id: r for r in merkle.op11_merkle_manifest(spark, SF).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for d, r in rows.items():
        broken = zlib.crc32(str(d).encode()) % 2 == 0 and "\n" in (texts[d] or "")
        assert r.verified != broken and (r.folded_root == r.root) == r.verified


# Ranked search -----------------------------------------------------------------------------------


def plain_search(docs, items, k=search.TOP):
    held = [(d, words_of(t.encode())) for d, t in docs if t and words_of(t.encode())]
    n_docs, n_words = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, words in held:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in {(i, t) for i, t in items}:
        scores = []
        for d, words in held:
            m = 75 + 25 * len(words) * n_docs // n_words
            score = 0
            for t in words_of((text or "").encode()):
                tf = words.count(t)
                if tf:
                    w = int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1))))
                    score += w * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def found_search(docs, items):
    return sorted((tuple(r) for r in search.ranked(docs, items).collect()), key=repr)


def test_search_of_odd_rows(spark, odd, none):
    items = [(1, "alpha DELTA one two", None, 1), (1, "mit license", None, 1), (2, None, None, 1), (3, "", None, 1),
             (None, "語 für shared line", None, 1), (4, "one one one two", "x", 1), (4, "one one one two", "y", 2), (5, "absent", None, 1)]
    frame = spark.createDataFrame(items, ITEMS)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert found_search(odd, frame) == plain_search(docs, [(i, t) for i, t, *_ in items])
    assert found_search(none, frame) == found_search(odd, frame.where("false")) == []


def test_search_reads_deep_enough(spark, monkeypatch):
    """Small depths, shards and blocks: many rounds, many ties, one word in nearly all documents."""
    monkeypatch.setattr(search, "FIRST_DEPTH", 1)
    monkeypatch.setattr(search, "DEEPER", 2)
    monkeypatch.setattr(search, "SHARD_DOCS", 37)
    monkeypatch.setattr(search, "BLOCK_BYTES", 100)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    docs = [(n, " ".join(["common", *rng.choices(vocabulary, weights, k=rng.choice([3, 8, 30]))])) for n in range(700)]
    docs += docs[:40] + [(None, docs[5][1])]
    items = [(n, " ".join(["common", *rng.choices(vocabulary, weights, k=rng.choice([1, 4, 12]))])) for n in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = found_search(frame, spark.createDataFrame([(*i, None, 1) for i in items], ITEMS))
    want = plain_search(docs, items)
    assert found == want and len(found) == 12 * search.TOP


def test_resolve_keeps_ties():
    docs = np.arange(30)
    lists = [(docs, np.full(30, 7), 2), (docs[:5], np.full(5, 1), 1)]
    rows, scores = search.resolve(lists, 30, 1, 10)
    assert set(rows) == set(range(30)) and sorted(set(scores)) == [14, 15]
    rows, _ = search.resolve(lists, 30, 15, 10)
    assert set(rows) == set(range(5))


# Decontamination ---------------------------------------------------------------------------------


def plain_hits(text, items, window):
    words = words_of((text or "").encode())
    hit, names = set(), set()
    for item, body in items:
        sought = words_of((body or "").encode())
        size = min(len(sought), window)
        windows = {tuple(sought[k:k + size]) for k in range(len(sought) - size + 1)} if size else set()
        for k in range(len(words) - size + 1):
            if tuple(words[k:k + size]) in windows:
                hit.update(range(k, k + size))
                names.add("" if item is None else str(item))
    return len(words), len(hit), sorted(names), hit


def test_contamination_against_plain(spark, odd, none, monkeypatch):
    items = [(1, "alpha beta gamma delta epsilon zeta shared line", None, 1), (2, "one two", None, 1), (3, "two three four five", None, 1),
             (None, "Für É", None, 1), (4, "", None, 1), (5, None, None, 1), (2, "mit license", None, 1),
             (10, "six one two three four five six one two three four five six", None, 1), (6, "one two three four five six one two three four", None, 1)]
    frame = spark.createDataFrame(items, ITEMS)
    want = sorted((repr((r.doc_id, *plain_hits(r.text, [i[:2] for i in items], 10)[:3])) for r in odd.collect()))
    for limit in (1 << 20, 40):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", limit)
        rows = decontaminate.contamination(odd, frame).collect()
        assert sorted(repr((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in rows) == want
    assert decontaminate.contamination(none, frame).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(odd, frame.where("false")).collect()} == {0}


def test_automaton_on_random_words():
    rng = random.Random(11)
    for trial in range(300):
        letters = "ab" if trial % 2 else "abcd"
        items = tuple((str(n % 7), " ".join(rng.choices(letters, k=rng.randint(1, 14))).encode()) for n in range(rng.randint(1, 6)))
        window = rng.randint(1, 6)
        held = decontaminate.Automaton(items, window)
        text = " ".join(rng.choices(letters + "x", k=60))
        spans, names = held.read(words_of(text.encode()))
        _, _, want, hit = plain_hits(text, [(i, t.decode()) for i, t in items], window)
        assert {k for a, b in spans for k in range(a, b)} == hit and sorted(names) == want


def test_spans_are_cut(spark):
    passage = "the quick brown fox jumps over the lazy dog and then rests"
    rows = [(1, f"Before, it. {passage.title()}! And after 語 it all went on for very much longer than that.", "a.b"),
            (2, passage, "x"), (3, "clean text", None), (4, None, None), (5, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `clean.row` string").withColumn("n_chars", F.length("text").cast("long"))
    items = spark.createDataFrame([(1, passage, None, 1)], ITEMS)
    found = {r.doc_id: r for r in decontaminate.decontaminated(docs, items).collect()}
    assert set(found) == {1, 3, 4, 5} and list(found[1].asDict()) == docs.columns
    assert found[1].text == "Before, it. ! And after 語 it all went on for very much longer than that."
    assert found[1].n_chars == len(found[1].text) and found[1]["clean.row"] == "a.b"
    assert found[3].text == "clean text" and found[4].text is None and found[5].text == ""
