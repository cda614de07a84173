"""Approximate nearest neighbours with balanced posting lists.

Centroids are fitted on a bounded sample by balanced splitting: a cluster with more than its share of
the sample is split in two until all are small, so that lists are balanced. A graph links each centroid
to its nearest ones and to its neighbours in the order of the splits, so that it hangs together; assigning and
searching walk this graph in memory. A vector goes to its nearest centroid and, near a boundary, also to others
whose distance is at most a ratio larger. A query reads the lists whose centroids are at most another ratio further
away than its nearest one (and ``LEAST_LISTS`` in any case). That ratio is the one that takes it to ``RECALL`` against
brute force on the sample: few lists where vectors form groups, most of them where they do not. All rows are indexed.

Inner product is turned into distance by one more component that gives all vectors the same norm.

A vector that occurs many times is indexed once with its smallest ids, as many as any query can return;
equal queries are searched once. Neighbouring lists share a cell, the larger the more lists are read, so that a
query travels to few cells; it meets the whole cell. Cells longer than a block, and cells that many queries read,
are dealt to several tasks, in which a block of vectors meets a block of queries.

Defined cases: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part; neither do null ids. Repeated rows (same id and vector) are one
candidate. An id with several vectors is as near as its nearest vector and is named once in a list; as a query it
has one list, over all its vectors. Empty tables give no rows. Only id and vector are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from norrsken.llm.common import checkpointed, documents

NEIGHBOURS = 20
QUERY_EVERY = 20
#: Rows of the fitting sample, vectors of the sample to a centroid, and most centroids (broadcast).
SAMPLE = 20_000
PER_CENTROID = 40
#: Links of a centroid to nearest ones, centroids from which a walk starts, and centroids that a walk opens at least.
LINKS = 16
ENTRIES = 96
BEAM = 64
#: Boundary vectors: copies at most, and ratio of squared distances up to which they are made.
COPIES = 4
COPY_RATIO = 1.15
#: Share of the sample's nearest vectors that must stand in the lists read, sample vectors it is measured with,
#: and fewest lists read.
RECALL = 0.97
TRIED = 250
LEAST_LISTS = 16
#: Cells that the lists read by a query on average would fill, if they were neighbours.
CELLS = 16
#: Vectors of a cell, and queries that read it, which meet in one task.
BLOCK = 4000
ASKED = 4000


@dataclass
class Index:
    centroids: np.ndarray
    links: np.ndarray
    entry: np.ndarray  # centroids from which a walk starts
    norm: float  # largest squared norm seen in the table

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """One more component that brings vectors to the largest norm; queries get 0 there."""
        rest = np.maximum(0.0, self.norm - (vectors**2).sum(1))
        return np.c_[vectors, np.sqrt(rest)]

    def walk(self, point: np.ndarray, beam: int, ratio: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Centroids and squared distances, nearest first, of a best-first walk of the graph. It opens the ``beam``
        nearest ones and all up to ``ratio`` times the least squared distance, and returns these."""
        ids = self.entry
        seen, opened = np.zeros(len(self.centroids), bool), np.zeros(len(self.centroids), bool)
        seen[ids] = True
        d = ((self.centroids[ids] - point) ** 2).sum(1)
        while True:
            order = np.argsort(d, kind="stable")
            keep = max(beam, int(np.searchsorted(d[order], ratio * d[order[0]], "right")))
            ids, d = ids[order[:keep]], d[order[:keep]]
            todo = ids[~opened[ids]]
            if not len(todo):
                return ids, d
            todo = todo[:max(8, len(todo) // 4)]
            opened[todo] = True
            new = np.unique(self.links[todo])
            new = new[~seen[new]]
            seen[new] = True
            ids, d = np.r_[ids, new], np.r_[d, ((self.centroids[new] - point) ** 2).sum(1)]

    def near(self, points: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``count`` nearest centroids of each point (all, if fewer), and squared distances."""
        count = min(count, len(self.centroids))
        walks = [self.walk(p, max(BEAM, count)) for p in points]
        return (np.array([ids[:count] for ids, _ in walks], np.int64).reshape(-1, count),
                np.array([d[:count] for _, d in walks]).reshape(-1, count))

    def within(self, points: np.ndarray, ratio: float) -> list[np.ndarray]:
        """The centroids whose lists each point reads: by ratio of squared distances, LEAST_LISTS at least."""
        out = []
        for p in points:
            ids, d = self.walk(p, BEAM, ratio)
            out.append(ids[:max(LEAST_LISTS, int(np.searchsorted(d, ratio * d[0], "right")))])
        return out

    def points_of(self, queries: np.ndarray) -> np.ndarray:
        return np.c_[queries * np.sqrt(self.norm / (queries**2).sum(1))[:, None], np.zeros(len(queries))]

    def lists_of(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists that hold each vector: numbers, and which of them count."""
        found, dist = self.near(self.lift(vectors), COPIES)
        return found, (dist <= COPY_RATIO * dist[:, :1]) | (np.arange(found.shape[1]) < 1)


def fit(sample: np.ndarray, norm: float, per_centroid: int = PER_CENTROID) -> Index:
    """Centroids by repeated balanced two-means, and the graph of their nearest neighbours."""
    lifted = Index(np.empty((0, 0)), np.empty(0), np.empty(0), norm).lift(sample)
    rng = np.random.default_rng(7)
    todo, leaves = [np.arange(len(lifted))], []
    while todo:
        own = todo.pop()
        x = lifted[own]
        if len(own) <= per_centroid or (x == x[0]).all():
            leaves.append(x.mean(0))
            continue
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(8):
            lead = ((x - a) ** 2).sum(1) - ((x - b) ** 2).sum(1)
            order = np.argsort(lead, kind="stable")
            # Balanced: no side gets less than a third.
            split = int(np.clip((lead < 0).sum(), len(x) // 3, len(x) - len(x) // 3))
            a, b = x[order[:split]].mean(0), x[order[split:]].mean(0)
        todo += [own[order[:split]], own[order[split:]]]
    centroids = np.array(leaves)
    lists = len(centroids)
    links = np.empty((lists, min(LINKS, lists)), np.int64)
    for at in range(0, len(centroids), 256):
        part = centroids[at:at + 256]
        d = (part**2).sum(1)[:, None] - 2 * part @ centroids.T + (centroids**2).sum(1)[None]
        links[at:at + 256] = np.argsort(d, axis=1, kind="stable")[:, :links.shape[1]]
    # Leaves are numbered in the order of the splits: that chain makes the graph one part.
    chain = np.clip(np.arange(lists)[:, None] + [-1, 1], 0, lists - 1)
    entry = np.unique(np.linspace(0, lists - 1, min(ENTRIES, lists)).astype(np.int64))
    return Index(centroids, np.c_[links, chain], entry, norm)


def reading_ratio(index: Index, sample: np.ndarray, k: int) -> tuple[float, int]:
    """The ratio of squared distances up to which a query reads lists, so that RECALL of its k nearest vectors of
    the sample are in them, and how many lists that is on average.

    A table larger than its sample is denser: neighbours are nearer, and a smaller ratio would do.
    """
    lists = len(index.centroids)
    if len(sample) <= 1:
        return 1.0, lists
    tried = np.random.default_rng(5).permutation(len(sample))[:TRIED]
    best = []
    for i in tried:
        scores = sample @ sample[i]
        scores[i] = -np.inf
        best.append(np.argsort(-scores, kind="stable")[:min(k, len(sample) - 1)])
    ids, at = np.unique(np.concatenate(best), return_inverse=True)
    found, counts = index.lists_of(sample[ids])
    points = index.points_of(sample[tried])
    needed = []
    for point, own in zip(points, at.reshape(len(tried), -1)):
        d = ((index.centroids - point) ** 2).sum(1)
        furthest = np.where(counts[own], d[found[own]], np.inf).min(1)
        needed.append(furthest / max(d.min(), np.finfo(float).tiny))
    ratio = float(np.quantile(np.concatenate(needed), RECALL, method="higher"))
    return ratio, int(np.ceil(np.mean([len(ids) for ids in index.within(points, ratio)])))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part, each (id, vector) once."""
    v = F.col(f"`{vector}`").cast("array<double>")
    big = F.lit(float("inf"))
    shaped = df.select(F.col(f"`{id}`").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0"
    ).where(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big)) & F.exists("v", lambda x: x != 0)
    )
    sizes = shaped.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return shaped.where(F.size("v") == (sizes["n"] if sizes else 0)).dropDuplicates(["vec_id", "v"])


def nearest(df: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS,
            every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of each query (ids divisible by ``every``): its k nearest found."""
    spark = df.sparkSession
    rows = usable(df, id, vector)
    key = F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(7), F.col("v")).alias("b"))
    keyed = checkpointed(rows.withColumn("key", key))
    # Of equal vectors only the k + 1 smallest ids can ever be returned (one may be the query's own).
    smallest = Window.partitionBy("key").orderBy("vec_id")
    few = keyed.select("key", "vec_id").withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    ids = few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = keyed.groupBy("key").agg(F.first("v").alias("v"))
    candidates = distinct.join(ids, "key")
    queries = keyed.where(F.col("vec_id") % every == 0)
    sample = distinct.orderBy(F.xxhash64("key")).limit(SAMPLE).select("v").toArrow()
    top = distinct.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).first()["m"]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(sample) or top is None:
        return empty
    fitted = _matrix(sample.column("v").combine_chunks())
    index = fit(fitted, top)
    ratio, read_lists = reading_ratio(index, fitted, k)
    per_cell = -(-read_lists // CELLS)
    index = spark.sparkContext.broadcast(index)

    def cells_of(read: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not len(batch):
                    continue
                v = _matrix(batch.column("v"))
                if read:
                    chosen = index.value.within(index.value.points_of(v), ratio)
                else:
                    chosen = [found[counts] for found, counts in zip(*index.value.lists_of(v))]
                # Lists are numbered in the order of the splits, so neighbours in number are neighbours.
                cells = pa.array([np.unique(lists // per_cell).tolist() for lists in chosen], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, cells], [*batch.schema.names, "cells"])
        return run

    key_type = "key struct<a:long,b:long>"
    indexed = candidates.select("key", "v", "ids").mapInArrow(
        cells_of(False), f"{key_type}, v array<double>, ids array<long>, cells array<long>"
    ).select("v", "ids", F.col("key"), F.explode("cells").alias("cell"))
    indexed = checkpointed(indexed)
    asked = checkpointed(queries.groupBy("key").agg(F.first("v").alias("v")).mapInArrow(
        cells_of(True), f"{key_type}, v array<double>, cells array<long>"
    ).select("key", "v", F.explode("cells").alias("cell")))

    def blocks_of(frame: DataFrame, name: str, most: int) -> DataFrame:
        return frame.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))

    def spread(name: str):
        return F.pmod(F.col("key.b"), F.col(name)).cast("int")

    def each(name: str):
        return F.explode(F.sequence(F.lit(0), F.col(name) - 1))

    # One row a cell that is both filled and asked for.
    blocks = blocks_of(indexed, "blocks", BLOCK).join(blocks_of(asked, "parts", ASKED), "cell")
    sliced = indexed.join(blocks, "cell").select("cell", spread("blocks").alias("block"), "v", "ids", each("parts").alias("part"))
    asked = asked.join(blocks, "cell").select("cell", "key", "v", spread("parts").alias("part"), each("blocks").alias("block"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(left) and len(right):
            q, x = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
            ids = right.column("ids").to_pylist()
            keys = left.column("key").to_pylist()
            for at in range(0, len(q), 512):
                scores = q[at:at + 512] @ x.T
                for i, row in enumerate(scores):
                    named, rows = {}, k + 1
                    while True:
                        if len(row) > rows:
                            edge = np.partition(row, len(row) - rows)[len(row) - rows]
                            best = np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge)))
                        else:
                            best = np.arange(len(row))
                        # Scores that are returned come from one and the same order of summing.
                        for j in best.tolist():
                            score = float(np.dot(q[at + i], x[j]))
                            named |= {n: max(score, named.get(n, score)) for n in ids[j]}
                        if len(named) > k or len(best) == len(row):
                            break
                        rows *= 2  # few ids with many vectors each
                    out += [(keys[at + i], n, s) for n, s in sorted(named.items(), key=lambda e: (-e[1], e[0]))[:k + 1]]
        kinds = [pa.struct([("a", pa.int64()), ("b", pa.int64())]), pa.int64(), pa.float64()]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "vec_id", "score"])

    meeting = ["cell", "block", "part"]
    found = asked.groupBy(*meeting).cogroup(sliced.groupBy(*meeting)).applyInArrow(
        search, f"{key_type}, vec_id long, score double"
    )
    # A boundary vector comes from several cells; copies of one pair have the same score.
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    pairs = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    listed = pairs.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    own = queries.select("key", F.col("vec_id").alias("query_id"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        own.join(listed, "key").where(F.col("query_id") != F.col("vec_id"))
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_nearest(spark, sf_dir: str) -> DataFrame:
    return nearest(documents(spark, sf_dir, "embeddings"))
