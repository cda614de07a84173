"""Token counts by rank-synchronous merging of pre-tokens held as ragged arrays.

Texts are split into pre-tokens; the distinct new ones of a batch become one flat symbol array, in
which every sequence applies its lowest-ranked pair at the same time until nothing merges. What
survives is the count of that pre-token, and a text's count is the sum over its pre-tokens. Counts
stay in a table of bounded size for the next batches of the worker; the table only saves time.

Defined cases: null or empty text has 0 tokens and 0 bytes; repeated rows and null ids give a row
each; special strings inside a text are one token each, as the library's default has it. Only id and
text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from norrsken.llm import bpe
from norrsken.llm.common import documents, pick, slices, texts_of

#: Texts of one round of merging.
BATCH_BYTES = 2 << 20
#: Pre-tokens whose counts a worker remembers; beyond it the table starts anew.
REMEMBERED = 1 << 18
#: Longer pre-tokens are merged each time instead of being remembered.
LONGEST = 64
LIMIT = 1024

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Counter:
    def __init__(self, path: str):
        self.merges = bpe.merges(path)
        self.split, self.special = bpe.split_pattern(), bpe.any_of(list(self.merges.special))
        self.known: dict[str, int] = {}

    def _pieces(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not (found := self.special.findall(text)):
            return self.split.findall(text), 0
        parts = self.special.split(text)
        return [t for part in parts for t in self.split.findall(part)], len(found)

    def count(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, pieces, specials = self.known, [], np.zeros(len(texts), np.int64)
        new: set[str] = set()
        for i, text in enumerate(texts):
            tokens, specials[i] = self._pieces(text)
            pieces.append(tokens)
            new.update(tokens)
        fresh = [t for t in new if t not in known]
        _, counts = self.merges.symbols([t.encode() for t in fresh])
        counts = dict(zip(fresh, counts.tolist()))
        known.update(counts)
        totals = np.fromiter((sum(map(known.__getitem__, tokens)) for tokens in pieces), np.int64, len(texts))
        for t in fresh:
            if len(t) > LONGEST:
                del known[t]
        return totals + specials


def token_counts(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None,
                 limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    place = path or bpe.vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(place)
        for batch in slices(batches, "text", BATCH_BYTES):
            column = batch.column("text")
            tokens = counter.count(texts_of(column))
            n_bytes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), n_bytes, pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return pick(df, doc_id=id, text=text).mapInArrow(count, SCHEMA)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))
