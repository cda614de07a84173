"""Helpers shared by the operators: written tables, batches of whole texts, column hygiene."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from norrsken.session import checkpointed

__all__ = ["WHITE", "checkpointed", "documents", "pick", "slices", "texts_of", "mix64", "splitmix"]

#: ASCII white space of the word patterns, as a Java character class body.
WHITE = "\\x20\\x09-\\x0D"


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named inputs under fixed names, so that further columns of the table cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of each batch in runs of at most ``limit`` text bytes; a longer text is a run of its own."""
    for batch in batches:
        column = batch.column(text)
        n = len(column)
        if n == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < n:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(column: pa.Array) -> list[str]:
    """The texts as Python strings, null as empty."""
    return [t or "" for t in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def splitmix(seed: int, n: int) -> np.ndarray:
    """n reproducible unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(steps + np.uint64(seed))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, f"[{WHITE}]+"))).cast("long")
