"""Connected components of a set of links, by alternating large-star and small-star steps.

Each step first shrinks every partition's links to a spanning forest, then hangs neighbours on the
smallest one of each node. Steps write a table in the shared folder, so no lineage grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from norrsken.llm.common import checkpointed

MOST_STEPS = 40


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a batch replaced by one from each node to the smallest node of its part."""
    for batch in batches:
        if not len(batch):
            continue
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        nodes, at = np.unique(np.r_[a, b], return_inverse=True)
        i, j = at[:len(a)], at[len(a):]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, label[i], low)
            np.minimum.at(new, label[j], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        hung = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[hung]), pa.array(nodes[label[hung]])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reached) of every node with a link."""
    shape = "a long, b long"
    now = checkpointed(links.select("a", "b").where("a <> b").mapInArrow(_forest, shape))
    mark = None
    for _ in range(MOST_STEPS):
        # Large star: each node's larger neighbours hang on its smallest neighbour or itself.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: smaller neighbours and the node itself hang on the smallest.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = checkpointed(small.unionByName(small_least.select("a", F.col("m").alias("b"))).distinct())
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
