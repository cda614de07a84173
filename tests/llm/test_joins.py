"""Jaccard join and nearest neighbours against brute force; components; the pipeline's stages."""

from __future__ import annotations

import random
import tracemalloc
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from norrsken.llm import jaccard as jc
from norrsken.llm import nearest as nn
from norrsken.llm.components import components


def _plain_sets(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate(
            {c: " " for c in range(9, 14)}).split(" ")
        w = [x for x in w if x]
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    return out


def _plain_components(ids, texts):
    sets = _plain_sets(texts)
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for j in holders[x]:
                if j < i:
                    common[j] += 1
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted((repr(d), len(s), repr(least.get(root(i)))) for i, (d, s) in enumerate(zip(ids, sets)))


def _mine(frame):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in jc.jaccard_components(frame).collect())


def test_sets_are_counted_like_plain_ones():
    texts = ["", None, " \t\n", "One", "one two three four", "A b c d e", "a b c d e f a b c d e f", "é É\x0bx y z w", "a b c d e f"]
    mine, plain = jc.shingle_sets(texts), _plain_sets(texts)
    assert [len(s) for s in mine] == [len(s) for s in plain]


def test_documents(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = frame.toPandas()
    assert _mine(frame) == _plain_components(table.doc_id.tolist(), table.text.tolist())


def _copies(seed, groups, copies, sizes, edits):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice(sizes))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randrange(edits + 1)):
                at = rng.randrange(len(own) + 1)
                kind = rng.random()
                if kind < 0.4:
                    own[at:at + 1] = [f"e{rng.randrange(10**6)}"]
                elif kind < 0.7:
                    own.insert(at, f"e{rng.randrange(10**6)}")
                else:
                    own = own[:at] + own[at + 3:]
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("seed,groups,copies,sizes,edits", [
    (1, 40, 8, list(range(5, 40)), 2), (2, 4, 120, [60, 80], 4), (3, 30, 10, [150, 300, 600], 14), (4, 1, 400, [100], 5),
    (5, 60, 5, list(range(6, 16)), 1),
])
def test_copies(spark, seed, groups, copies, sizes, edits):
    texts = _copies(seed, groups, copies, sizes, edits)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert _mine(frame) == _plain_components(range(len(texts)), texts)


def _generated(plan) -> int:
    """Rows that the plan's generators made, after a run."""
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    if plan.nodeName() == "AdaptiveSparkPlan":
        inner = [plan.executedPlan()]
    elif plan.nodeName().endswith("QueryStage"):
        inner = [plan.plan()]
    else:
        inner = [plan.children().apply(k) for k in range(plan.children().size())]
    return own + sum(map(_generated, inner))


def test_a_pair_of_many_buckets_is_opened_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(600)]
    texts = [" ".join(words), " ".join([*words, "x"]), " ".join(f"v{i}" for i in range(600))]
    plain, made = jc.checkpointed, []

    def counted(df):
        if "explode(array(a" in df._jdf.queryExecution().toString():
            df.collect()
            made.append(_generated(df._jdf.queryExecution().executedPlan()))
        return plain(df)

    monkeypatch.setattr(jc, "checkpointed", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert _mine(frame) == _plain_components(range(len(texts)), texts)
    assert made == [2]


def test_hashing_holds_little_beside_many_texts():
    texts = [" ".join(f"w{i}{k}" for i in range(400)) for k in range(800)]
    tracemalloc.start()
    try:
        found = jc.shingle_sets(texts)
        held = tracemalloc.get_traced_memory()[1] - sum(s.nbytes for s in found)
    finally:
        tracemalloc.stop()
    assert held < 30e6  # of texts of 2 MB; 85 MB with all numbers of a batch at once
    assert [len(s) for s in found] == [396] * 800


def test_common_passage(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rng = random.Random(9)
    texts = [passage + " " + " ".join(f"o{n} q{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 12))) for n in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert _mine(frame) == _plain_components(range(len(texts)), texts)


def test_pairs_share_a_signature():
    """Every linked pair of sets meets in a signature, whatever the sizes."""
    rng = np.random.default_rng(4)
    maker = jc.Signatures()
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        r = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        s = np.unique(np.r_[rng.permutation(r)[int(rng.integers(0, max(1, n // 4))):], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 4) + 1)), dtype=np.uint64)])
        if not len(s) or not jc.links(len(r), len(s), len(np.intersect1d(r, s))) or np.array_equal(r, s):
            continue
        (a, fa), (b, fb) = maker.of(r), maker.of(s)
        small, big = ((a, fa), (b, fb)) if len(r) <= len(s) else ((b, fb), (a, fa))
        met = np.intersect1d(small[0][small[1] & 1 > 0], big[0][big[1] & 2 > 0])
        back = np.intersect1d(big[0][big[1] & 1 > 0], small[0][small[1] & 2 > 0]) if len(r) == len(s) else []
        assert len(met) or len(back)


def test_odd_documents(odd, none, odd_rows):
    assert _mine(odd) == sorted(
        (d, n, c) for d, n, c in _plain_components([r[0] for r in odd_rows], [r[1] for r in odd_rows]))
    assert jc.jaccard_components(none).count() == 0
    kept = jc.first_of_each(odd).collect()
    ids = [r.doc_id for r in kept]
    assert 5 in ids and 6 not in ids and 9 in ids and 10 not in ids and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_copy_without_id_links_others(spark):
    words = [f"w{i}" for i in range(200)]
    far = [*words]
    far[20], far[180] = "x", "y"
    between = [*words]
    between[20] = "x"
    ends = [" ".join(words), " ".join(between), " ".join(far)]
    ends[0] = ends[0].replace("w100 ", "z z z ")
    ends[2] = ends[2].replace("w60 ", "q q q ").replace("w140 ", "r r r ")
    sets = _plain_sets(ends)
    like = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in ((0, 1), (1, 2), (0, 2))]
    assert like[0] >= 0.8 and like[1] >= 0.8 > like[2]
    frame = spark.createDataFrame([(5, ends[0]), (None, ends[1]), (9, ends[2])], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jc.jaccard_components(frame).collect()} == {(5, 5), (None, 5), (9, 5)}


def test_first_of_each_decides_by_row(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (2, one + " end"), (2, two), (2, two), (7, three), (None, three), (None, one), (None, "d e f g h i"),
            (None, "d e f g h i"), (3, ""), (4, ""), (4, "")]
    frame = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, tie int")
    kept = jc.first_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(1, one), (2, two), (7, three), (None, "d e f g h i"), (3, ""), (4, "")], key=repr)


def test_first_of_each_keeps_any_columns(spark):
    text = " ".join(f"a{i}" for i in range(60))
    frame = spark.createDataFrame(
        [(1, text, 10, {"a": 1}, 1), (1, text, 10, {"a": 1}, 1), (2, text, 11, {"a": 2}, 2), (3, "b c", 12, None, 3)],
        "doc_id long, text string, _key int, `m.n` map<string,int>, nth int")
    kept = jc.first_of_each(frame)
    assert kept.columns == frame.columns and kept.dtypes == frame.dtypes
    assert sorted((r[0], r[2], r[3], r[4]) for r in kept.collect()) == [(1, 10, {"a": 1}, 1), (3, 12, None, 3)]


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 700)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(6)).collect()}
    parent = {n: n for p in pairs for n in p}
    for _ in range(300):
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: parent[n] for n in linked}


# Nearest neighbours


def _plain_nearest(table, k=20):
    v = np.array(table.embedding.tolist(), np.float64)
    ids = table.vec_id.to_numpy()
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        scores = v @ v[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:k]
        out[ids[i]] = [(ids[j], scores[j]) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    want, got = _plain_nearest(frame.toPandas()), defaultdict(dict)
    vectors = {r.vec_id: np.array(r.embedding, np.float64) for r in frame.collect()}
    for r in nn.nearest(frame).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), rel=1e-12, abs=1e-15)
    recall = np.mean([len({x[0] for x in got[q].values()} & {x[0] for x in w}) / len(w) for q, w in want.items()])
    assert recall >= 0.9
    for found in got.values():
        ranked = [found[i] for i in range(1, len(found) + 1)]
        assert ranked == sorted(ranked, key=lambda x: (-x[1], x[0])) and len(ranked) == 20


def test_recall_of_many_vectors_without_groups(spark):
    v = np.random.default_rng(3).normal(size=(20_000, 64))
    v = (v / np.sqrt((v**2).sum(1))[:, None]).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}))
    got = defaultdict(set)
    for r in nn.nearest(frame, every=200).collect():
        got[r.query_id].add(r.vec_id)
    want = {}
    for i in range(0, len(v), 200):
        scores = v.astype(np.float64) @ v[i].astype(np.float64)
        scores[i] = -np.inf
        want[i] = set(np.argsort(-scores, kind="stable")[:20].tolist())
    assert set(got) == set(want)
    assert np.mean([len(got[q] & w) / 20 for q, w in want.items()]) >= 0.95


def _grouped(n, groups, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, 32))
    return middles[rng.integers(groups, size=n)] + 0.3 * rng.normal(size=(n, 32))


def test_recall_of_grouped_vectors(spark):
    v = _grouped(12_000, 60, 11)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": v.tolist()}))
    got = defaultdict(set)
    for r in nn.nearest(frame, every=100).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for i in range(0, len(v), 100):
        scores = v @ v[i]
        scores[i] = -np.inf
        hits.append(len(got[i] & set(np.argsort(-scores, kind="stable")[:20].tolist())) / 20)
    assert np.mean(hits) >= 0.95


@pytest.mark.parametrize("groups", [1, 60])
def test_walks_of_the_graph_find_what_all_distances_find(groups):
    v = _grouped(10_000, groups, 5)
    index = nn.fit(v, float((v**2).sum(1).max()))
    assert len(index.centroids) > 4 * nn.BEAM
    points = index.points_of(v[:200])
    ratio, average = nn.reading_ratio(index, v, 20)
    found = wanted = first = 0
    for point, lists, (near, _) in zip(points, index.within(points, ratio), zip(*index.near(points, 4))):
        d = ((index.centroids - point) ** 2).sum(1)
        want = set(np.flatnonzero(d <= ratio * d.min())) | set(np.argsort(d, kind="stable")[:nn.LEAST_LISTS])
        assert len(set(lists.tolist())) == len(lists) and set(lists.tolist()) <= set(range(len(d)))
        found, wanted = found + len(want & set(lists.tolist())), wanted + len(want)
        first += near[0] == d.argmin()
    assert found >= 0.99 * wanted and first >= 0.99 * len(points)
    if groups > 1:
        assert average < len(index.centroids) / 2


def test_an_id_with_several_vectors_is_named_once(spark):
    rng = np.random.default_rng(2)
    rows = [(7, (rng.normal(size=4) * 0.01 + [5, 0, 0, 0]).tolist()) for _ in range(60)]
    rows += [(20, [1.0, 0.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0, 0.0])]
    rows += [(i, rng.normal(size=4).tolist()) for i in range(101, 131)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    best = defaultdict(lambda: -np.inf)
    for n, x in rows[62:] + rows[:60]:
        for q in ([1, 0, 0, 0], [0, 1, 0, 0]):
            best[n] = max(best[n], float(np.dot(x, q)))
    want = sorted(best, key=lambda n: (-best[n], n))[:20]
    got = [r.vec_id for r in nn.nearest(frame).where("query_id = 20").orderBy("rank").collect()]
    assert got == want and got[0] == 7


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5], "x") for i in range(0, 60)] + [
        (60, [0.0, 0.0], "x"), (61, None, "x"), (62, [1.0, nan], "x"), (63, [inf, 1.0], "x"), (64, [1.0], "x"),
        (65, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (66, [2.0, 2.0], "x"), (66, [2.0, 2.0], "x"), (80, [-1.0, 3.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = defaultdict(list)
    for r in nn.nearest(frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == {0, 20, 40, 80}
    assert got[20] == [66, *[i for i in range(25) if i != 20][:19]]
    assert got[80][:2] == [66, 0]
    assert nn.nearest(frame.where("false")).count() == 0


# Pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes, name
        table = pd.DataFrame([r.asDict() for r in docs.collect()])
        if name == "jaccard_join":
            plain = _plain_components(table.doc_id.tolist(), table.text.tolist())
            assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(d for d, _, c in plain if d == c)
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() == packed.count()
