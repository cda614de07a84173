"""Document fingerprints by randomised edit embedding.

All texts take the same random walk over their characters: at step j on a character c, a shared random
bit of (j, c) says whether the walk stays on c or goes on to the next one. What the walk reads at each
step is the embedding; a few edits shift it for a while until the walks meet again, so that edit
distance shows as Hamming distance. A fingerprint samples SLOTS steps of the embedding, each as one
byte hashed out of step and character. The steps are sampled consistently: slot s has a random
sequence of steps on which records are set, and takes the last record below the embedding's length,
so that texts of like length sample the same steps.

The walk stays on a character for a whole run of steps, so one table look-up per character (the next
step whose bit lets it go) replaces the steps; the texts of a batch walk side by side as arrays.

Near texts are found by bit-sampled banding (each band is a fixed random choice of fingerprint bits)
and verified on all slots.

Defined cases: null text is empty; an empty text's fingerprint is all zero. Next documents go by
descending id, ties by a hash of the text, null ids last; after the last comes the first; a sole document follows itself.
Repeated rows give a row each. Only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from norrsken.llm.common import checkpointed, documents, mix64, pick, slices, splitmix, texts_of

SLOTS = 128
#: Steps after which the shared random bits repeat, and classes of characters that share bits.
PERIOD = 8192
CLASSES = 256
#: Characters that walk side by side.
BATCH_CHARS = 8 << 20
#: Bands, and bits of each, for near texts. At a likeness of NEAR bits agree at 0.9, and a pair shares a band at
#: 1 - (1 - 0.9**24)**40 = 0.96.
BANDS = 40
BAND_BITS = 24
NEAR = 0.8
#: Members of a bucket that meet in one task, and members of small buckets that share a task.
BLOCK = 1000
TASK_ROWS = 20_000

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, shares_band_edited boolean, shares_band_next boolean"
)


@lru_cache(maxsize=1)
def stays() -> np.ndarray:
    """For each class and step (of one period), how many steps a walk spends on a character of the class."""
    bits = (splitmix(11, CLASSES * PERIOD) >> np.uint64(63)).astype(bool).reshape(CLASSES, PERIOD)
    bits[:, -1] = True  # no run is longer than a period
    steps = np.arange(PERIOD, dtype=np.int32)
    goes = np.where(bits, steps, PERIOD)
    following = np.minimum.accumulate(goes[:, ::-1], axis=1)[:, ::-1]
    return (following - steps + 1).astype(np.uint8).ravel()


@lru_cache(maxsize=1)
def records() -> list[np.ndarray]:
    """Per slot, the steps at which its random sequence sets a record, up to 2**40 steps."""
    out = []
    for slot in range(SLOTS):
        draws = (splitmix(1000 + slot, 256) >> np.uint64(11)).astype(np.float64) / 2.0**53
        at, steps = 1.0, [0]
        for u in draws:
            at = np.floor(at / max(u, 1e-12)) + 1
            if at > 2.0**40:
                break
            steps.append(int(at) - 1)
        out.append(np.array(steps, np.int64))
    return out


@lru_cache(maxsize=1 << 16)
def _sampled(length: int) -> np.ndarray:
    return np.array([r[np.searchsorted(r, length) - 1] for r in records()], np.int64)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def classes_of(points: np.ndarray) -> np.ndarray:
    return ((points ^ (points >> 8)) & (CLASSES - 1)).astype(np.uint8)


def walk(classes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Step at which each character is reached, and each text's end, for texts at ``starts`` whose walks begin at step ``first``.

    Texts are walked side by side, longest first, one character of each at a time.
    """
    table = stays()
    reached = np.empty(len(classes), np.int32 if lengths.max(initial=0) < 2**22 else np.int64)
    order = np.argsort(-lengths, kind="stable")
    at, step = starts[order].copy(), first[order].astype(np.int64)
    # active[i]: texts longer than i characters
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")
    for n in active.tolist():
        here, now = at[:n], step[:n]
        reached[here] = now
        now += table[(classes[here].astype(np.int64) << 13) + (now & (PERIOD - 1))]
        here += 1
    out_end = np.empty(len(lengths), np.int64)
    out_end[order] = step
    return reached, out_end


def _bytes(points: np.ndarray, reached: np.ndarray, length: int) -> bytes:
    if length == 0:
        return bytes(SLOTS)
    steps = _sampled(length)
    chars = points[np.searchsorted(reached, steps, "right") - 1].astype(np.uint64)
    mixed = mix64(chars * np.uint64(0x9E3779B97F4A7C15) + steps.astype(np.uint64))
    return (mixed >> np.uint64(56)).astype(np.uint8).tobytes()


class Walked:
    """Texts with their walks: points, steps reached, and length of the embedding of each."""

    def __init__(self, texts: list[str]):
        self.points = [points_of(t) for t in texts]
        lengths = np.array([len(p) for p in self.points], np.int64)
        flat = np.concatenate(self.points) if texts else np.empty(0, "<u4")
        starts = np.cumsum(lengths) - lengths
        reached, self.ends = walk(classes_of(flat), starts, lengths, np.zeros(len(texts), np.int64))
        self.reached = [reached[a:a + n] for a, n in zip(starts, lengths)]

    def fingerprint(self, i: int) -> bytes:
        return _bytes(self.points[i], self.reached[i], int(self.ends[i]))


def fingerprints_of(texts: list[str]) -> list[bytes]:
    walked = Walked(texts)
    return [walked.fingerprint(i) for i in range(len(texts))]


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots."""
    return float(np.mean(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)))


@lru_cache(maxsize=1)
def _band_slots() -> np.ndarray:
    return (splitmix(77, BANDS * BAND_BITS) % np.uint64(SLOTS * 8)).astype(np.int64).reshape(BANDS, BAND_BITS)


def bands(fingerprint: bytes) -> list[int]:
    """Per band, its sampled bits of the fingerprint as a number that also holds the band's place."""
    bits = np.unpackbits(np.frombuffer(fingerprint, np.uint8))[_band_slots()].astype(np.int64)
    return ((bits << np.arange(BAND_BITS)).sum(1) + (np.arange(BANDS, dtype=np.int64) << BAND_BITS)).tolist()


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (binary), bands (array<long>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_CHARS):
            prints = fingerprints_of(texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(prints, pa.binary()),
                 pa.array([bands(p) for p in prints], pa.list_(pa.int64()))],
                ["doc_id", "fingerprint", "bands"],
            )

    return pick(df, doc_id=id, text=text).mapInArrow(run, "doc_id long, fingerprint binary, bands array<long>")


def _near_forest(prints: np.ndarray, near: float) -> list[tuple[int, int, float]]:
    """Near pairs (i, j, likeness) that link the rows of ``prints`` wherever pairs of all rows would."""
    equal = np.zeros((len(prints), len(prints)), np.uint8)
    for slot in prints.T:
        equal += slot[:, None] == slot[None]
    out, seen = [], np.zeros(len(prints), bool)
    for root in range(len(prints)):
        todo = [] if seen[root] else [root]
        seen[root] = True
        while todo:
            i = todo.pop()
            new = np.flatnonzero((equal[i] >= near * SLOTS) & ~seen)
            seen[new] = True
            out += [(i, j, equal[i, j] / SLOTS) for j in new.tolist()]
            todo += new.tolist()
    return out


def near_documents(df: DataFrame, id: str = "doc_id", text: str = "text", near: float = NEAR) -> DataFrame:
    """doc_id, near_id, likeness: verified near pairs, enough to link all documents that near pairs of a bucket link.

    Documents of one fingerprint stand in for each other. In a band's bucket all members are held against each
    other, in pairs of blocks where the bucket is large; a meeting gives fewer pairs than it has members.
    """
    prints = checkpointed(fingerprints(df, id, text))
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"))
    opened = checkpointed(classes.select("first_id", "fingerprint", F.explode("bands").alias("band")))
    buckets = checkpointed(opened.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    tasks = (buckets.agg(F.sum("n")).first()[0] or 0) // TASK_ROWS + 1
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = opened.join(buckets, "band").withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int")).withColumn(
        "task", F.when(F.col("blocks") > 1, F.col("band")).otherwise(-1 - F.pmod(F.xxhash64("band"), F.lit(tasks))))
    met = members.select(
        "task", "band", "first_id", "fingerprint", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    ).select("task", "band", "first_id", "fingerprint", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"))

    def link(table: pa.Table) -> pa.Table:
        table = table.sort_by([("band", "ascending"), ("first_id", "ascending"), ("fingerprint", "ascending")])
        band = table.column("band").to_numpy()
        ids, raw = table.column("first_id").to_pylist(), table.column("fingerprint").to_pylist()
        flat = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, SLOTS)
        cuts = [0, *(np.flatnonzero(np.diff(band)) + 1).tolist(), len(band)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            for i, j, like in _near_forest(flat[a:b], near):
                # Ids were sorted with null last.
                i, j = a + min(i, j), a + max(i, j)
                out.append((raw[j], ids[i], like))
        kinds = [pa.binary(), pa.int64(), pa.float64()]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["fingerprint", "near_id", "likeness"])

    verified = met.groupBy("task", "row", "col").applyInArrow(
        link, "fingerprint binary, near_id long, likeness double").distinct()
    return prints.join(verified, "fingerprint").select("doc_id", "near_id", "likeness").unionByName(
        prints.join(classes.select("fingerprint", "first_id"), "fingerprint")
        .where(F.col("first_id") < F.col("doc_id"))
        .select("doc_id", F.col("first_id").alias("near_id"), F.lit(1.0).alias("likeness"))
    )


def edited_prints(texts: Walked, nexts: list[np.ndarray]) -> tuple[list[bytes], list[str]]:
    """Fingerprint and SHA-256 of each text with its last third replaced by the start of the next one.

    The walk of the kept part is taken up where it ends.
    """
    keeps = [len(p) - len(p) // 3 for p in texts.points]
    tails = [n[: len(p) // 3] for p, n in zip(texts.points, nexts)]
    lengths = np.array([len(t) for t in tails], np.int64)
    first = np.array([r[k] if k < len(r) else e for r, k, e in zip(texts.reached, keeps, texts.ends)], np.int64)
    starts = np.cumsum(lengths) - lengths
    reached, ends = walk(classes_of(np.concatenate(tails)), starts, lengths, first)
    prints, digests = [], []
    for i, (a, n, k) in enumerate(zip(starts, lengths, keeps)):
        points = np.concatenate([texts.points[i][:k], tails[i]])
        steps = np.concatenate([texts.reached[i][:k], reached[a:a + n]])
        prints.append(_bytes(points, steps, int(ends[i])))
        whole = points.tobytes().decode("utf-32-le", "surrogatepass")
        digests.append(hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest())
    return prints, digests


def compare_with_next(ids: list, texts: list[str], follower: str) -> pa.RecordBatch:
    """A result row for each text; each is followed by the one after it, the last by ``follower``."""
    walked = Walked([*texts, follower])
    prints = [walked.fingerprint(i) for i in range(len(texts) + 1)]
    nexts = walked.points[1:]
    walked.points, walked.reached, walked.ends = walked.points[:-1], walked.reached[:-1], walked.ends[:-1]
    edited, digests = edited_prints(walked, nexts)
    own = [set(bands(p)) for p in prints]
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(p) for p in walked.points], pa.int64()), pa.array(digests),
        pa.array([p.hex() for p in prints[:-1]]), pa.array([e.hex() for e in edited]),
        pa.array([likeness(p, e) for p, e in zip(prints, edited)]),
        pa.array([likeness(p, q) for p, q in zip(prints, prints[1:])]),
        pa.array([not b.isdisjoint(bands(e)) for b, e in zip(own, edited)]),
        pa.array([not b.isdisjoint(c) for b, c in zip(own, own[1:])]),
    ]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])


_ENDS = ["partition", "is_last", "end_id", "end_text"]
_ENDS_SCHEMA = "partition int, is_last boolean, end_id long, end_text string"


def _with_ends(rows: pa.RecordBatch | None, partition: int, ends: list[tuple]) -> pa.RecordBatch:
    """Result rows, then the partition's first and last document under the columns of _ENDS."""
    n = len(rows) if rows is not None else 0
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
    columns = [
        pa.concat_arrays([rows.column(c), pa.nulls(len(ends), k)]) if n else pa.nulls(len(ends), k)
        for c, k in zip(names, kinds)
    ]
    extra = [
        pa.array([None] * n + [partition] * len(ends), pa.int32()),
        pa.array([None] * n + [e[0] for e in ends], pa.bool_()),
        pa.array([None] * n + [e[1] for e in ends], pa.int64()),
        pa.array([None] * n + [e[2] for e in ends], pa.string()),
    ]
    return pa.RecordBatch.from_arrays([*columns, *extra], [*names, *_ENDS])


def fingerprints_with_edits(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the contract: fingerprints of each text and its edit, and likeness to edit and next text.

    Texts are sorted by ranges of ids once. Each range is read in order and compares neighbours; its
    first and last documents, two for each range, are written apart, and a second, small step joins
    the ends of neighbouring ranges.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        kept: tuple | None = None
        for batch in slices(batches, "text", BATCH_CHARS):
            ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))
            ends = []
            if kept is None:
                ends.append((False, ids[0], texts[0]))
            else:
                ids, texts = [kept[0], *ids], [kept[1], *texts]
            kept = (ids[-1], texts[-1])
            rows = compare_with_next(ids[:-1], texts[:-1], texts[-1]) if len(ids) > 1 else None
            if rows is not None or ends:
                yield _with_ends(rows, partition, ends)
        if kept is not None:
            yield _with_ends(None, partition, [(True, *kept)])

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text_, next_ in zip(*(batch.column(c).to_pylist() for c in ("end_id", "end_text", "next_text"))):
                yield compare_with_next([id_], [text_], next_)

    keys = (F.col("doc_id").desc_nulls_last(), F.col("tie"))
    ordered = (
        pick(df, doc_id=id, text=text).withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    )
    written = checkpointed(ordered.mapInArrow(run, f"{SCHEMA}, {_ENDS_SCHEMA}"))
    ends = written.where(F.col("partition").isNotNull()).select(*_ENDS)
    order = Window.orderBy("partition", "is_last")
    followed = ends.withColumn("next_text", F.coalesce(
        F.lead("end_text").over(order),
        F.first("end_text").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )).where("is_last")
    return written.where(F.col("partition").isNull()).drop(*_ENDS).unionByName(followed.mapInArrow(join_ends, SCHEMA))


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints_with_edits(documents(spark, sf_dir))
