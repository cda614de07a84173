"""Packing by bounded-space online best-fit.

Documents are tokenised where they lie; only their pieces' lengths and checksums travel. A document of
at most ``capacity`` ids is one piece. A longer one is cut from the end, so that its first piece is the
shorter one and all others fill a sequence by themselves. Pieces are dealt by a hash of their id to
groups of bounded size; in each group a fixed number of bins is open, kept in a bitset keyed by free
space. A piece goes to the open bin that it leaves fullest; without one it opens a new bin, and if that
is one too many, the fullest open bin closes.

Defined cases: null or empty text is a document of the closing id alone; null ids and repeated rows are
packed like all others (equal rows are packed once each). Further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from norrsken.llm import bpe
from norrsken.llm.common import checkpointed, documents, pick, slices, texts_of

CAPACITY = 2048
#: Id that ends each document.
CLOSING = 0
#: Bins open at a time.
OPEN_BINS = 8192
#: Pieces of a group: what one task packs.
GROUP = 50_000
BATCH_BYTES = 1 << 20
#: Units whose ids a worker remembers (about 200 bytes each); beyond it the table starts anew.
REMEMBERED = 1 << 20
#: Longer units are encoded each time instead of being remembered.
LONGEST = 64
#: Units encoded in one call of the library.
RUN = 1024
#: A space that begins a pre-token.
BEGINS = re.compile(r" (?=\S)")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def _as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    held = array("I", ids)
    if sys.byteorder == "big":
        held.byteswap()
    return held.tobytes()


class Ids:
    """Ids of texts by the library, which sees each distinct unit of a worker's batches once.

    A unit is a stretch from one space to the next. A space before anything but white space always begins
    a pre-token, and merges never cross a pre-token's ends, so the units' ids in a row are the text's.
    Where white space follows a space, the stretch goes on to the next space that does begin a pre-token.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: struct.pack("<I", k) for k, t in self.library.get_added_tokens_decoder().items()}
        self.cut = regex.compile(f"({bpe.any_of(list(self.special)).pattern})") if self.special else None
        self.known: dict[str, bytes] = {}
        # Whether an id's token begins with a space; GPT-style byte alphabets write it as this letter.
        self.spaced = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        for token, k in self.library.get_vocab(with_added_tokens=False).items():
            self.spaced[k] = token.startswith("\u0120")

    def _parts(self, text: str) -> list[str]:
        """The stretches between special strings at even places, the strings themselves at odd ones."""
        return self.cut.split(text) if any(s in text for s in self.special) else [text]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [_as_bytes(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit_ids(self, units: list[str]) -> list[bytes]:
        """Ids of units, many to a text of their own: the ids of one begin where a token has its space."""
        runs = [units[i:i + RUN] for i in range(0, len(units), RUN)]
        found = self.library.encode_batch_fast([f" {' '.join(run)}" for run in runs], add_special_tokens=False)
        out: list[bytes] = []
        for run, encoded in zip(runs, found):
            ids = np.array(encoded.ids, "<u4")
            edges = np.append(np.flatnonzero(self.spaced[ids]), len(ids)) * 4
            if len(edges) == len(run) + 1:
                raw, at = ids.tobytes(), edges.tolist()
                out += [raw[a:b] for a, b in zip(at, at[1:])]
            else:  # a vocabulary that writes spaces otherwise
                out += self._ids([f" {u}" for u in run])
        return out

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special strings."""
        units = [t.split(" ") for t in texts]
        heads = [u.pop(0) for u in units]  # no space before it
        fresh = set().union(*units).difference(self.known)
        if odd := {u for u in fresh if not u or u[0].isspace()}:  # never remembered, so always among the fresh
            for i, t in enumerate(texts):
                if not odd.isdisjoint(units[i]):
                    heads[i], *units[i] = BEGINS.split(t)
            fresh = set().union(*units).difference(self.known)
        fresh = list(fresh)
        self.known.update(zip(fresh, self._unit_ids(fresh)))
        known = self.known.__getitem__
        ids = [head + b"".join(map(known, u)) for head, u in zip(self._ids(heads), units)]
        for u in fresh:
            if len(u) > LONGEST:
                del self.known[u]
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the closing id included."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts = [self._parts(t) for t in texts]
        plain = iter(self._plain([p for each in parts for p in each[::2]]))
        closing = struct.pack("<I", CLOSING)
        return [
            b"".join(self.special[p] if k % 2 else next(plain) for k, p in enumerate(each)) + closing
            for each in parts
        ]


@lru_cache(maxsize=1)
def ids_by(path: str) -> Ids:
    """One for all tasks of a worker, so that the file is read and common units are encoded once."""
    return Ids(path)


def pieces(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None,
           capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the documents' pieces of at most ``capacity`` ids."""
    place = path or bpe.vocabulary_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_by(place)
        for batch in slices(batches, "text", BATCH_BYTES):
            rows: list[tuple] = []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), ids.encode(texts_of(batch.column("text")))):
                n = len(raw) // 4
                ends = range((n - 1) % capacity + 1, n + 1, capacity)
                start = 0
                for k, end in enumerate(ends):
                    rows.append((doc, k, start, end - start, zlib.crc32(raw[4 * start:4 * end])))
                    start = end
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return pick(df, doc_id=id, text=text).mapInArrow(cut, PIECES)


class OpenBins:
    """Open bins by free space. Bit f of ``free`` is set while some open bin has f ids of space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.free, self.opened = capacity, most, 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset of a piece."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1  # least space that suffices
            bin_number = self._take(space)
        else:
            space, bin_number = self.capacity, self.opened
            self.opened += 1
        left = space - length
        if left:
            if self.count == self.most:  # the fullest open bin closes
                fullest = (self.free & -self.free).bit_length() - 1
                if fullest >= left:  # this one is the fullest
                    return bin_number, self.capacity - space
                self._take(fullest)
            self.at[left].append(bin_number)
            self.free |= 1 << left
            self.count += 1
        return bin_number, self.capacity - space

    def _take(self, space: int) -> int:
        bins = self.at[space]
        bin_number = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.count -= 1
        return bin_number


def packed(cut: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
           group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset.

    Pieces come in the order of a hash, so that reruns agree and long and short ones mix.
    """
    cut = checkpointed(cut)  # tokenised once; the row count below is then free
    groups = max(1, -(-cut.count() // group))

    def pack(table: pa.Table) -> pa.Table:
        number = table.column("pack")[0].as_py() if len(table) else 0
        order = pc.sort_indices(
            table, [("mixed", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]
        )
        table = table.take(order)
        bins = OpenBins(capacity, open_bins)
        places = np.array([bins.place(n) for n in table.column("length").to_pylist()], np.int64).reshape(-1, 2)
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        out = out.append_column("sequence_id", pa.array(number * (1 << 32) + places[:, 0]))
        return out.append_column("offset", pa.array(places[:, 1]))

    mixed = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = cut.withColumn("mixed", mixed).withColumn("pack", F.pmod(F.xxhash64("mixed"), F.lit(groups)))
    return dealt.groupBy("pack").applyInArrow(pack, PACKED)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return packed(pieces(documents(spark, sf_dir)))
