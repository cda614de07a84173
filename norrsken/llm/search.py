"""Ranked lexical search by NRA: impact-sorted lists are read in sequence, never looked into at random.

One pass over the texts keeps each document's length and its counts of query terms. A fixed-size bit table
of the terms' hashes says which words those are; what it lets through by chance is dropped with the exact
terms later. The corpus counts (documents, words, documents of each term) come out of the kept counts.

Documents are then searched where they lie, in shards. A shard holds one list for each term, its documents by
falling impact. For a query all its lists are read to the same depth, four times deeper in each round. What was
read of a document is its lower bound; the last impacts read of the lists it was not seen in, added, make its
upper bound. Reading ends when every document whose upper bound reaches the bar has equal bounds: members,
ties and scores are final. The bar is the k-th largest lower bound, and at least the k-th score of the
partition's earlier shards. Each partition sends k rows a query; a window limited to k merges them.

Defined cases: null and empty texts, and texts without a word, are no documents; null ids rank after all others
of the same score; documents of one id are ranked each for itself; queries equal in id and text are one, those
of one id with unlike texts are ranked each for itself; a query without words, or whose words no document
holds, has no rows; empty tables give none; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from norrsken.llm.common import checkpointed, documents, pick, slices
from norrsken.llm.words import binary_texts, blocks_of, words_of

TOP = 20
#: Bits of the term filter: 1 MB.
FILTER_BITS = 1 << 23
#: Bytes of query texts of a block, which is searched for in one pass over the kept counts.
BLOCK_BYTES = 4 << 20
#: Documents, and list entries, of a shard.
SHARD_DOCS = 20_000
SHARD_ENTRIES = 4_000_000
#: First depth of reading, and how much deeper each round goes.
FIRST_DEPTH = 512
DEEPER = 4
#: Words whose filter bit a worker remembers.
REMEMBERED = 1 << 20
BATCH_BYTES = 8 << 20

KEPT = "doc_id long, n long, terms array<binary>, tfs array<long>"


def query_terms(items: DataFrame) -> DataFrame:
    """q, block, term, qtf of items (q, block, text)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, block, terms, counts = [], [], [], []
            for number, part, raw in zip(*(batch.column(n).to_pylist() for n in ("q", "block", "text"))):
                found = Counter(words_of(raw))
                q += [number] * len(found)
                block += [part] * len(found)
                terms += found.keys()
                counts += found.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(block, pa.int64()), pa.array(terms, pa.binary()),
                 pa.array(counts, pa.int64())], ["q", "block", "term", "qtf"])

    texts = items.select("q", "block", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(read, "q long, block long, term binary, qtf long")


def term_filter(terms: DataFrame) -> bytes:
    """One bit for each hash of a term. Its size is FILTER_BITS, however many terms there are."""
    number = F.pmod(F.xxhash64("term"), F.lit(FILTER_BITS)) + 1
    rows = terms.select(number.alias("number")).groupBy(F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    bits = bytearray(FILTER_BITS // 8)
    for row in rows.collect():
        start = (row["bucket"] - 1) * 4096
        bits[start:start + 4096] = row["bits"]
    return bytes(bits)


class Filter(dict):
    """word -> whether its bit is set, remembered."""

    def __init__(self, bits: bytes):
        self.bits = bits

    def __missing__(self, word: bytes) -> bool:
        # The hash of Spark's xxhash64, so that the table could be built there.
        at = xxhash.xxh64_intdigest(word, 42) % FILTER_BITS
        found = self[word] = bool(self.bits[at >> 3] >> (at & 7) & 1)
        return found


def kept_counts(docs: DataFrame, bits: bytes) -> DataFrame:
    """doc_id, n, terms, tfs of every document with a word; only terms that the filter lets through."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Filter(bits)
        for batch in slices(batches, "text", BATCH_BYTES):
            if len(wanted) > REMEMBERED:
                wanted.clear()
            ids, lengths, ends, terms, counts = [], [], [0], [], []
            for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = words_of(raw.as_py())
                if not words:
                    continue
                found = {w: n for w, n in Counter(words).items() if wanted[w]}
                ids.append(doc)
                lengths.append(len(words))
                terms += found.keys()
                counts += found.values()
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary())),
                 pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(read, KEPT)


def resolve(lists: list[tuple[np.ndarray, np.ndarray, int]], n: int, bar: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that reach the k-th score (ties with it included) and ``bar``, and their exact scores.

    ``lists`` holds (documents, impacts by falling impact, factor) for each term of the query.
    """
    lower = np.zeros(n, np.int64)
    done, depth = 0, FIRST_DEPTH
    while True:
        unread, seen = 0, np.zeros(n, np.int64)
        for docs, impacts, factor in lists:
            lower[docs[done:depth]] += impacts[done:depth] * factor
            if depth < len(docs):
                bound = int(impacts[depth - 1]) * factor
                unread += bound
                seen[docs[:depth]] += bound
        upper = lower + (unread - seen)
        if n > k:
            bar = max(bar, int(np.partition(lower, n - k)[n - k]))
        alive = np.flatnonzero(upper >= bar)
        if (upper[alive] == lower[alive]).all():
            return alive, lower[alive]
        done, depth = depth, depth * DEEPER


class Shard:
    """Documents of a partition whose lists are searched together."""

    def __init__(self):
        self.docs: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = self.entries = 0

    def add(self, docs: np.ndarray, terms: np.ndarray, at: np.ndarray, impacts: np.ndarray) -> None:
        self.docs.append(docs)
        self.parts.append((terms, at + self.n, impacts))
        self.n += len(docs)
        self.entries += len(terms)

    def lists(self, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends of each term's list, and documents and impacts of all lists, by falling impact."""
        terms, at, impacts = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((-impacts, terms))
        ends = np.cumsum(np.bincount(terms, minlength=n_terms))
        return ends, at[order], impacts[order]


def _best(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by falling score, then by id; the largest integer stands for a null id and comes last."""
    order = np.lexsort((docs, -scores))[:k]
    return scores[order], docs[order]


NO_ID = np.iinfo(np.int64).max


def _searched(kept: DataFrame, terms: dict[bytes, int], weights: np.ndarray,
              queries: dict[int, list[tuple[int, int]]], n_docs: int, n_words: int, k: int) -> DataFrame:
    """q, doc_id, score, no_id: the k best documents of each partition for every query of a block."""

    def impacts_of(batch: pa.RecordBatch):
        ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        lists = batch.column("terms")
        words = lists.flatten().dictionary_encode()
        names = np.array([terms.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
        term = names[words.indices.to_numpy(zero_copy_only=False)] if len(names) else np.zeros(0, np.int64)
        tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False)
        lengths = np.diff(lists.offsets.to_numpy())
        at = np.repeat(np.arange(len(ids)), lengths)
        m = 75 + 25 * batch.column("n").to_numpy() * n_docs // n_words
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[at]))
        real = (term >= 0) & (impact > 0)
        return ids, term[real], at[real], impact[real]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def finish(shard: Shard) -> None:
            ends, at, impacts = shard.lists(len(weights))
            ids = np.concatenate(shard.docs)
            for q, wanted in queries.items():
                lists = []
                for t, factor in wanted:
                    start, end = ends[t - 1] if t else 0, ends[t]
                    if end > start:
                        lists.append((at[start:end], impacts[start:end], factor))
                if not lists:
                    continue
                scores, docs = best.get(q, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                bar = int(scores[-1]) if len(scores) == k else 1
                rows, found = resolve(lists, shard.n, bar, k)
                if len(rows):
                    best[q] = _best(np.r_[scores, found], np.r_[docs, ids[rows]], k)

        shard = Shard()
        for batch in batches:
            if not len(batch):
                continue
            shard.add(*impacts_of(batch))
            if shard.n >= SHARD_DOCS or shard.entries >= SHARD_ENTRIES:
                finish(shard)
                shard = Shard()
        if shard.n:
            finish(shard)
        q = np.repeat(np.fromiter(best, np.int64, len(best)), [len(s) for s, _ in best.values()] or 0)
        scores, docs = (np.concatenate([b[i] for b in best.values()] or [np.zeros(0, np.int64)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(q), pa.array(docs, mask=docs == NO_ID), pa.array(scores)], ["q", "doc_id", "score"])

    return kept.mapInArrow(search, "q long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for every item."""
    c = F.col
    wanted, blocks = blocks_of(pick(items, item_id=item_id, text=item_text).distinct(), "text", BLOCK_BYTES)
    wanted = checkpointed(wanted.withColumn("q", F.monotonically_increasing_id()))
    terms = checkpointed(query_terms(wanted))
    kept = checkpointed(kept_counts(binary_texts(docs, id, text), term_filter(terms)))
    totals = kept.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    held = kept.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = checkpointed(terms.join(held, "term"))
    found = None
    for block in range(blocks):
        # One block's terms come to the driver: its size is bounded by BLOCK_BYTES of text.
        rows = weighed.where(c("block") == block).toArrow()
        names: dict[bytes, int] = {}
        weights: list[int] = []
        queries: dict[int, list[tuple[int, int]]] = {}
        columns = (rows.column(n).to_pylist() for n in ("q", "term", "qtf", "df"))
        for q, term, qtf, df in zip(*columns):
            weight = floor(1000 * log((2 * totals["docs"] + 2) / (2 * df + 1)))
            if weight > 0:
                if term not in names:
                    names[term] = len(weights)
                    weights.append(weight)
                queries.setdefault(q, []).append((names[term], qtf))
        # A last weight of 0 stands for words that the filter let through by chance (index -1).
        part = _searched(kept, names, np.array([*weights, 0], np.int64), queries,
                         totals["docs"] or 0, totals["words"] or 1, k)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("q").orderBy(c("score").desc(), c("doc_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)
    return best.join(wanted.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


_PATTERN = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

ORACLE = f"""
with words as (
  select rowid d, doc_id, unnest(regexp_extract_all(text, '{_PATTERN}')) w from (
    select row_number() over () rowid, doc_id, text from documents)
), counted as (
  select d, doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term, count(*) tf
  from words group by all
), lengths as (
  select d, sum(tf)::bigint n from counted group by d
), corpus as (
  select count(*) docs, sum(n)::bigint total from lengths
), spread as (
  select term, count(*) df from counted group by term
), wanted as (
  select item_id, text, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') term, count(*) qtf
  from (select item_id, text, unnest(regexp_extract_all(text, '{_PATTERN}')) w from (
    select distinct item_id, text from benchmark)) group by all
), scored as (
  select i.item_id, i.text, c.d, c.doc_id,
         sum(i.qtf * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint
             * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::bigint score
  from wanted i join spread using (term) join counted c using (term) join lengths using (d) cross join corpus
  group by all
), ordered as (
  select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) rank
  from scored where score > 0
)
select item_id, rank, doc_id, score from ordered where rank <= {TOP}
"""
