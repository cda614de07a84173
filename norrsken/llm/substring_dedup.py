"""Substring dedup by hashing lines and sentences.

Units are lines of any length and, for passages that stand within a line, sentences of at least
``MIN_WORDS`` words, as well as a sentence's rest from its last capitalised word on (where a passage was
put into a sentence). Units are normalised by lower case and single spaces. Their 128-bit digests are
grouped over the whole corpus; the occurrence of lowest rank (document id, then place in the document)
stays, all others go, and the offsets of what goes in the original text are kept with the result. A unit
that goes always has an earlier copy that stays: a unit around that copy would have its own, still
earlier, copy with the same words in it.

Defined cases: blank units stay; null text stays null with 0 units; null ids rank last; rows equal in id
and text are treated alike; a unit repeated within a document stays once. Only id and text are read, so
further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from norrsken.llm.common import checkpointed, documents, pick, slices
from norrsken.llm.line_dedup import _LARGEST

#: Fewest words of a unit that is not a whole line.
MIN_WORDS = 8
BATCH_BYTES = 2 << 20

_UNITS = "doc long, tag long, start long, length long, h1 long, h2 long"
_REMOVED = "n_units long, n_removed long, removed array<struct<start:long,length:long>>, clean_text string"
#: White space after the end of a sentence, and (searched backwards) the last capitalised word.
_END = regex.compile(r"(?<=[.!?…。！？])\s+")
_LAST_CAPITAL = regex.compile(r"(?r)(?<=\s)[\p{Lu}\p{Lt}]")


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).lower().encode("utf-8", "surrogatepass"))


def units_of(text: str | None) -> list[tuple[int, int, bytes]]:
    """Start, length and digest of each unit. The sentences of a line tile it, white space included."""
    out, start = [], 0
    for line in (text or "").split("\n"):
        if words := line.split():
            out.append((start, len(line), _digest(words)))
        if len(words) >= MIN_WORDS:
            cuts = [0, *(m.end() for m in _END.finditer(line)), len(line)]
            for a, b in zip(cuts, cuts[1:]):
                sentence = line[a:b]
                words = sentence.split()
                n = len(words)
                if n < MIN_WORDS:
                    continue
                if b - a < len(line):
                    out.append((start + a, b - a, _digest(words)))
                last = next((i for i in range(n - 1, 0, -1) if words[i][0].isupper()), 0)
                if last and n - last >= MIN_WORDS and (m := _LAST_CAPITAL.search(sentence)):
                    rest = sentence[m.start():]
                    out.append((start + a + m.start(), len(rest), _digest(rest.split())))
        start += len(line) + 1
    return out


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", BATCH_BYTES):
        found = [units_of(text) for text in batch.column("text").to_pylist()]
        rows = [u for units in found for u in units]
        if not rows:
            continue
        owner = pa.array(np.repeat(np.arange(len(found)), [len(units) for units in found]))
        starts, lengths, digests = zip(*rows)
        halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc").take(owner), batch.column("tag").take(owner), pa.array(starts, pa.int64()),
             pa.array(lengths, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
            [f.split()[0] for f in _UNITS.split(", ")])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Start and length of the stretches that the spans cover; a newline parts two of them."""
    out: list[tuple[int, int]] = []
    for start, length in sorted(spans):
        if out and start <= sum(out[-1]):
            first = out[-1][0]
            out[-1] = first, max(sum(out[-1]), start + length) - first
        else:
            out.append((start, length))
    return out


def without(text: str, stretches: list[tuple[int, int]]) -> str:
    """The text without sorted stretches; a line that is covered as a whole goes with its newline."""
    kept, at, k = [], 0, 0
    for line in text.split("\n"):
        end, parts, begin, whole = at + len(line), [], at, False
        while k < len(stretches) and stretches[k][0] < end:
            start, length = stretches[k]
            whole = length == len(line)
            parts.append(text[begin:start])
            begin, k = start + length, k + 1
        if not whole:
            kept.append("".join(parts) + text[begin:end])
        at = end + 1
    return "\n".join(kept)


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string()]
    for batch in slices(batches, "text", BATCH_BYTES):
        rows = []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            stretches = merged([(g["start"], g["length"]) for g in gone or []])
            n_units = 0 if text is None else text.count("\n") + 1
            rows.append((n_units, len(stretches), [{"start": a, "length": n} for a, n in stretches],
                         without(text, stretches) if stretches else text))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
            ["doc_id", "n_units", "n_removed", "removed", "clean_text"])


def substring_dedup(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_units (lines), n_removed, removed (start and length in the original text), clean_text of every row.

    ``removed`` holds the stretches that removed units cover, ``n_removed`` their number.
    """
    base = pick(df, doc_id=id, text=text).withColumns({
        "doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LARGEST)), "tag": F.xxhash64("text")})
    units = base.select("doc", "tag", "text").mapInArrow(_units, _UNITS)
    place = F.struct("doc", "tag", "start", "length")
    # Written, so that the join below has a shuffle on both sides and a common unit's occurrences can be split.
    firsts = checkpointed(
        units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").select("h1", "h2", "first")
    )
    gone = (
        units.join(firsts, ["h1", "h2"]).where(place != F.col("first"))
        .groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "length")).alias("gone"))
    )
    joined = base.join(gone, ["doc", "tag"], "left").select("doc_id", "text", "gone")
    kind = base.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(_removed, f"doc_id {kind}, {_REMOVED}")


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
