"""Benchmark decontamination: a generalised suffix automaton of the test items, through which texts stream.

The automaton of all items' words is built once a worker. Each text runs through it word by word; the automaton
gives the longest sequence of words ending there that stands in some item. Where it is a window long, all of its
words are hit, and the state that holds the last window names the items. An item shorter than a window is one
window itself and is found at the states that end with the whole item.

Items come in blocks of bounded size. With more than one, texts pass through one block's automaton after the
other, spans and items added up, the table written between passes.

Defined cases: null and empty texts have no words and are not contaminated; null and empty items are ignored;
a null item id counts as an empty one; items of one id are one item with several texts; repeated and null
document ids are judged each for itself; empty tables give no rows, or clean ones; further columns are ignored
by ``contamination`` and kept by ``decontaminated``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from norrsken.llm.common import checkpointed, documents, pick, slices
from norrsken.llm.words import binary_texts, blocks_of, word_bounds, words_of

#: Words of a window.
WINDOW = 10
#: Bytes of item texts of a block: about 150,000 words, and twice as many states at most.
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
#: Spans longer than this are cut out; a document hit in a larger share than this goes whole.
MOST_WORDS = 9
MOST_SHARE = 0.5

SPANS = "array<struct<start:int,stop:int>>"


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: tuple[tuple[str, bytes], ...], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbers = self.numbers
        sequences = [
            (item, [numbers.setdefault(w, len(numbers)) for w in words_of(text)]) for item, text in items
        ]
        for _, sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        #: State of a window -> items that hold it.
        self.held: list[set[str] | None] = [None] * len(self.step)
        #: State -> (length, item) of the short items that end there.
        self.short: dict[int, list[tuple[int, str]]] = {}
        self.least = window
        self._name_windows(sequences)

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, at: int, word: int) -> int:
        """The state reached from ``at`` by ``word`` for sequences one word longer than ``at``'s longest."""
        target = self.step[at][word]
        if self.length[target] == self.length[at] + 1:
            return target
        copy = self._state(self.length[at] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while at >= 0 and self.step[at].get(word) == target:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.step[last]:  # an earlier item already goes on like this
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.step[last]:
            self.step[last][word] = new
            last = self.link[last]
        if last >= 0:
            self.link[new] = self._split(last, word)
        return new

    def _name_windows(self, sequences: list[tuple[str, list[int]]]) -> None:
        """Each item is put at the states of its windows; ``at`` leads from a longer match to its last window."""
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        self.at = [0] * len(self.step)
        for state in order:
            up = self.link[state]
            self.at[state] = self.at[up] if self.length[up] >= self.window else state
        for item, sequence in sequences:
            state = 0
            for k, word in enumerate(sequence):
                state = self.step[state][word]
                if k + 1 >= self.window:
                    place = self.at[state]
                    if self.held[place] is None:
                        self.held[place] = set()
                    self.held[place].add(item)
            if 0 < len(sequence) < self.window:
                self.short.setdefault(state, []).append((len(sequence), item))
                self.least = min(self.least, len(sequence))

    def _short_ends(self, state: int, matched: int) -> list[tuple[int, str]]:
        """Short items that end with a match of ``matched`` words in ``state``."""
        found = []
        while state > 0:
            found += [s for s in self.short.get(state, ()) if s[0] <= matched]
            state = self.link[state]
        return found

    def read(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged spans of hit words, and the items hit."""
        step, link, length, window = self.step, self.link, self.length, self.window
        least = self.least if self.short else window
        spans: list[list[int]] = []
        items: set[str] = set()
        places: set[int] = set()
        state = matched = 0
        for k, word in enumerate(map(self.numbers.get, words), 1):
            if word is None:
                state = matched = 0
                continue
            onward = step[state].get(word)
            while onward is None and state:
                state = link[state]
                matched = length[state]
                onward = step[state].get(word)
            state = onward or 0
            matched = matched + 1 if onward else 0
            if matched < least:
                continue
            start = k
            if matched >= window:
                places.add(self.at[state])
                start = k - matched
            if self.short:
                for size, item in self._short_ends(state, matched):
                    items.add(item)
                    start = min(start, k - size)
            if start < k:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, k])
        return spans, items.union(*(self.held[p] for p in places))


@lru_cache(maxsize=1)
def automaton_of(items: tuple[tuple[str, bytes], ...], window: int) -> Automaton:
    """One for all tasks of a worker."""
    return Automaton(items, window)


def _joined(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, those that meet as one."""
    merged: list[list[int]] = []
    for start, stop in sorted(spans):
        if merged and merged[-1][1] >= start:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    return merged


def _span_array(rows: list[list[list[int]]]) -> pa.Array:
    flat = np.array([s for spans in rows for s in spans], np.int32).reshape(-1, 2)
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(ends), pairs)


def _read_by(df: DataFrame, items: tuple[tuple[str, bytes], ...], window: int) -> DataFrame:
    """``df`` (text, n_words, spans, items and others) with what one block's automaton finds added."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton_of(items, window)
        for batch in slices(batches, "text", BATCH_BYTES):
            counts, spans, names = [], [], []
            earlier = zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            for raw, (old, named) in zip(batch.column("text"), earlier):
                words = words_of(raw.as_py())
                new, hit = found.read(words)
                counts.append(len(words))
                spans.append(_joined([[s["start"], s["stop"]] for s in old] + new) if old else new)
                names.append(sorted(hit.union(named)))
            out = {"n_words": pa.array(counts, pa.int64()), "spans": _span_array(spans),
                   "items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(
                [out.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)

    return df.mapInArrow(read, df.schema)


def _marked(df: DataFrame, items: DataFrame, id: str, text: str, item_id: str, item_text: str, window: int,
            *more: Column) -> DataFrame:
    """doc_id, text (bytes), n_words, spans, items of every row, and ``more`` columns."""
    wanted = pick(items, item=item_id, text=item_text).where(F.length("text") > 0).distinct()
    wanted = wanted.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text")
    blocked, blocks = blocks_of(wanted, "text", BLOCK_BYTES)
    out = binary_texts(
        df, id, text, F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"),
        F.array().cast("array<string>").alias("items"), *more)
    for block in range(blocks):
        # One block comes to the driver and goes to the workers: its size is bounded by BLOCK_BYTES.
        rows = blocked.where(F.col("block") == block).select("item", F.col("text").cast("binary").alias("text")).collect()
        held = tuple(sorted((r["item"], bytes(r["text"])) for r in rows))
        out = _read_by(checkpointed(out) if block else out, held, window)
    return out


def _n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def contamination(df: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, spans (of hit words, from 0, end excluded) and items (ids as text, sorted) of every row."""
    marked = _marked(df, items, id, text, item_id, item_text, window)
    return marked.select("doc_id", "n_words", _n_hit().alias("n_hit"), "spans", "items")


def decontaminated(df: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", length: str = "n_chars", window: int = WINDOW,
                   most_words: int = MOST_WORDS, most_share: float = MOST_SHARE) -> DataFrame:
    """The rows under the same columns, without spans of more than ``most_words`` hit words.

    A row of whose words more than ``most_share`` are hit goes whole. ``length`` is brought up to date.
    """
    c = F.col
    row = F.struct(*[c(f"`{n}`") for n in df.columns]).alias("row")
    marked = _marked(df, items, id, text, item_id, item_text, window, row)
    kept = marked.where(_n_hit() <= c("n_words") * most_share)
    cutting = F.filter("spans", lambda s: s["stop"] - s["start"] > most_words)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            cuts = batch.column("cutting").to_pylist()
            for raw, spans in zip(batch.column("text"), cuts):
                raw = raw.as_py()
                if spans:
                    bounds, parts, start = word_bounds(raw), [], 0
                    for s in spans:
                        parts.append(raw[start:bounds[s["start"]][0]])
                        start = bounds[s["stop"] - 1][1]
                    raw = b"".join([*parts, raw[start:]])
                clean.append(raw)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(clean, pa.binary()), pa.array([bool(s) for s in cuts], pa.bool_())],
                ["row", "clean", "changed"])

    schema = kept.select("row", c("text").alias("clean"), F.lit(True).alias("changed")).schema
    cleaned = kept.select("row", "text", cutting.alias("cutting")).mapInArrow(cut, schema)
    whole = F.when(c("changed"), c("clean").cast("string")).otherwise(c("row").getField(text))
    size = F.when(c("changed"), F.length(c("clean").cast("string")).cast("long")).otherwise(c("row").getField(length))
    out = {text: whole, length: size}
    return cleaned.select(*[out.get(n, c("row").getField(n)).alias(n) for n in df.columns])


def op13_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = ("regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

ORACLE = f"""
with docs as (
  select row_number() over () d, doc_id, coalesce({_WORDS.format("text")}, []) words from documents
), items as (
  select coalesce(item_id::varchar, '') item, {_WORDS.format("text")} words from benchmark where text is not null
), windows as (
  select distinct item, least(len(words), {WINDOW}) size,
         array_to_string(words[k + 1 : k + least(len(words), {WINDOW})], ' ') body
  from (select item, words, unnest(range(greatest(len(words) - {WINDOW - 1}, 1))) k from items where len(words) > 0)
), sizes as (
  select distinct size from windows
), places as (
  select d, size, k, array_to_string(words[k + 1 : k + size], ' ') body
  from (select d, words, size, unnest(range(len(words) - size + 1)) k from docs, sizes where len(words) >= size)
), found as (
  select d, item, k, p.size from places p join windows w on w.body = p.body and w.size = p.size
), hits as (
  select d, count(distinct word)::bigint n_hit from (select d, unnest(range(k, k + size)) word from found) group by d
), named as (
  select d, count(*)::bigint n_items, string_agg(item, ',' order by item) items
  from (select distinct d, item from found) group by d
)
select doc_id, len(words)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from docs left join hits using (d) left join named using (d)
"""
