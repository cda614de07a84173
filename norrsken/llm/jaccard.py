"""N-gram Jaccard join: exact near-duplicate links by partitioning the hashed universe.

A document's set holds the 64-bit hashes of its distinct word shingles, sorted. Sets are banded by
size. Within a band the universe of hashes is cut into m segments of equal width, so a set's part in
each segment is a run of its sorted hashes. Two sets with 9 x |symmetric difference| <= |r| + |s| (a
similarity of 0.8 means just that) can differ in at most H places; so among any H + 1 segments at
least one is equal in both sets. Each set is indexed once, under all segments of its own band, and
probes its own band and those of smaller sets it can be linked with. A probe spends H + 1 units where
candidates are few: on its fullest segments first (an equal run of many hashes is rare), then, where
segments are empty, on pairs of units for one segment with its one-deletion neighbourhood (which finds
parts that differ by one hash), and on empty segments only at last.

Signatures travel as packed arrays by bucket. In a bucket small groups give their pairs; a large group
gives pairs with two leaders, and its member list. Pairs are verified on the whole sets, best supported
first, and those whose ends are linked already are left out, since only components are asked for. The
members of large groups that then still lie in several components are regrouped by their rarest hashes,
which parts what shares no more than a common passage. Groups still in several components are opened:
each member outside the group's largest component meets all of a small group and a few of a large one,
then what is left of large groups is held against the whole group in blocks of bounded size. So no link between different components is lost, and
no group is expanded into pairs.

Defined cases: null text, text without words: empty set, linked with nothing; fewer words than a
shingle: the whole sequence is one shingle; equal sets are one class, whatever their number; null ids
take part and are no component id unless a component has no other; repeated rows give a row each. Only
id and text are read, so further columns cannot clash. Shingles and sets are told apart by 64-bit and
128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from norrsken.llm.common import checkpointed, documents, mix64, pick, slices, splitmix
from norrsken.llm.components import components

WORDS = 5
#: Links: 100 * intersection >= 80 * union. The bounds below follow from it.
BATCH_BYTES = 2 << 20
#: Text bytes hashed at once: each takes some 60 bytes of numbers meanwhile.
HASHED_BYTES = 1 << 18
#: Ratio of neighbouring size bands.
BAND_RATIO = 1.25
#: Segments beyond the H + 1 that the largest probe needs, and the share of segments with one-deletion entries.
SLACK = 0.12
RESERVE = 0.06
#: Sets up to this size have one-deletion entries for all segments.
SMALL = 24
#: Shingles of one bucket of signatures.
BUCKET = 750_000
LEAST_BUCKETS = 32
#: Groups up to this size give their pairs at once.
GROUP = 6
#: Second round: groups in which each unlinked member meets all others, and its partners in larger ones.
MEET_ALL = 40
PARTNERS = 3
#: Members of a block in the last round.
BLOCK = 1000

_INDEX, _PROBE = 1, 2
_U32 = np.uint64(32)


def links(a: int, b: int, common: int) -> bool:
    return 100 * common >= 80 * (a + b - common)


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    runs: list[list[bytes]] = [[]]
    held = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if held + len(raw) > HASHED_BYTES and runs[-1]:
            runs.append([])
            held = 0
        runs[-1].append(raw)
        held += len(raw)
    return [s for run in runs for s in _run_sets(run, n)]


def _run_sets(raw: list[bytes], n: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    ends = np.cumsum(lengths)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~white
    edge = np.diff(np.r_[np.int8(0), word.view(np.int8)])
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[np.ndarray] = []
    if len(starts) == 0:
        return [np.empty(0, np.uint64)] * len(raw)
    with np.errstate(over="ignore"):
        # A word's hash: its letters times powers of two odd numbers, by place in the word.
        place = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
        longest = int((stops - starts).max())
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(longest, 0x5851F42D4C957F2D, np.uint64)])
        letters = mix64(np.arange(256, dtype=np.uint64) + np.uint64(1))[lower]
        terms = np.where(word, letters * power[np.minimum(place, longest)], np.uint64(0))
        hashes = mix64(np.add.reduceat(terms, starts) + (stops - starts).astype(np.uint64))
        factors = splitmix(3, n) | np.uint64(1)
        shingles = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for i in range(n):
            shingles += mix64(hashes[i:i + len(shingles)] * factors[i])
        shingles = mix64(shingles)
        first = np.searchsorted(starts, ends - lengths)
        last = np.searchsorted(starts, ends)
        for a, b in zip(first.tolist(), last.tolist()):
            if b - a >= n:
                out.append(np.unique(shingles[a:b - n + 1]))
            elif b > a:
                out.append(mix64(np.add.reduce(mix64(hashes[a:b] * factors[:b - a]), keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def short(name: bytes) -> int:
    """The first half of a set's name, as used in signatures."""
    return int.from_bytes(name[:8], "little", signed=True)


def band_of(size: int) -> tuple[int, int]:
    """Lowest and highest size of the band that holds a size."""
    low = 1
    while True:
        high = max(low, int(low * BAND_RATIO) - 1)
        if size <= high:
            return low, high
        low = high + 1


def segments_of(high: int) -> int:
    """Segments of a band: enough for the largest set that can be linked with one of it, and some more."""
    most = (high + high * 5 // 4) // 9 + 1
    return most + int(np.ceil(SLACK * most)) + (1 if high > 2 else 0)


class Signatures:
    """Signatures of a set: 64-bit values and flags."""

    def __init__(self):
        self.bands: dict[int, tuple[int, int, int, int]] = {}

    def band(self, size: int) -> tuple[int, int, int, int]:
        """low, high, segments, segments with one-deletion entries"""
        if size not in self.bands:
            low, high = band_of(size)
            m = segments_of(high)
            self.bands[size] = low, high, m, m if high <= SMALL else int(np.ceil(RESERVE * m))
        return self.bands[size]

    def bands_of(self, size: int) -> list[tuple[int, int, int, int]]:
        """The bands a set is compared in: its own first, then those of smaller sets it can be linked with."""
        out, at = [], size
        while at >= -(-4 * size // 5) and at > 0:
            out.append(self.band(at))
            at = out[-1][0] - 1
        return out

    def offset(self, size: int, other: int) -> int:
        """Where the profile of a set of ``size`` holds the segments of the band of ``other``."""
        at = 0
        for band in self.bands_of(size):
            if band[0] <= other <= band[1]:
                break
            at += band[2]
        return at

    def profile(self, s: np.ndarray) -> bytes:
        """One byte of each segment's hash, band after band: equal segments have equal bytes."""
        upto = np.r_[np.uint64(0), np.cumsum(mix64(s))]
        parts = []
        for _, _, m, _ in self.bands_of(len(s)):
            ends = np.searchsorted(((s >> _U32) * np.uint64(m)) >> _U32, np.arange(m, dtype=np.uint64), "right")
            parts.append((mix64(np.diff(upto[ends], prepend=np.uint64(0))) >> np.uint64(56)).astype(np.uint8))
        return b"".join(p.tobytes() for p in parts)

    def of(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(s)
        values, flags = [], []
        mixed = mix64(s)
        upto = np.r_[np.uint64(0), np.cumsum(mixed)]
        bands = self.bands_of(size)
        own = bands[0]
        for band in bands:
            low, high, m, reserve = band
            with np.errstate(over="ignore"):
                salt = np.uint64(low) * np.uint64(0x9E3779B97F4A7C15)
            # Segments have equal width on the upper half of the hashes, so sorted hashes come in order.
            seg = (((s >> _U32) * np.uint64(m)) >> _U32).astype(np.int64)
            counts = np.bincount(seg, minlength=m)
            ends = np.cumsum(counts)
            sums = upto[ends] - upto[ends - counts]
            names = mix64(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt)
            exact = mix64(sums + names)
            flag = np.zeros(m, np.uint8)
            spend = np.zeros(m, np.uint8)
            units = (size + min(size, high)) // 9 + 1
            if units > 1:
                filled = int((counts > 0).sum())
                if filled >= units:
                    spend[np.argsort(-counts, kind="stable")[:units]] = 1
                else:
                    spend[counts > 0] = 1
                    short_by = units - filled
                    pairs = np.flatnonzero(counts[:reserve] > 0)[:short_by]
                    spend[pairs] = 2
                    short_by -= len(pairs)
                    spend[np.flatnonzero(counts == 0)[:short_by]] = 1
            flag[spend > 0] |= _PROBE
            # One-deletion entries: of indexed sets for the reserve, of probes where two units are spent.
            shorter = seg < reserve if band is own else spend[seg] == 2
            picked = np.flatnonzero(shorter)
            if band is own:
                flag |= _INDEX
            take = flag > 0
            values.append(exact[take])
            flags.append(flag[take])
            if len(picked):
                g = seg[picked]
                values.append(mix64(sums[g] - mixed[picked] + names[g]))
                # A deletion meets only exact parts: it is a probe's for exact entries, or an entry for exact probes.
                kind = np.zeros(len(picked), np.uint8)
                if band is own:
                    kind |= np.where(g < reserve, _INDEX, 0).astype(np.uint8)
                kind |= np.where(spend[g] == 2, _PROBE, 0).astype(np.uint8)
                flags.append(kind)
        return np.concatenate(values), np.concatenate(flags)


_SIGNATURES = "bucket int, nodes binary, sizes binary, owners binary, signatures binary, flags binary"
_FOUND = "a long, b long, support long, members array<long>"


def _emit_signatures(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Signatures()
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text", BATCH_BYTES):
                unique: dict[bytes, np.ndarray] = {}
                for s in shingle_sets(batch.column("text").to_pylist()):
                    if len(s):
                        unique.setdefault(digest(s), s)
                if not unique:
                    continue
                made = [maker.of(s) for s in unique.values()]
                nodes = np.array([short(d) for d in unique], np.int64)
                sizes = np.array([len(s) for s in unique.values()], np.uint32)
                owners = np.repeat(np.arange(len(made), dtype=np.uint32), [len(v) for v, _ in made])
                values, flags = (np.concatenate(x) for x in zip(*made))
                bucket = (values >> _U32) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                columns: list[list] = [[], [], [], [], [], []]
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    mine = order[cuts[b]:cuts[b + 1]]
                    own, local = np.unique(owners[mine], return_inverse=True)
                    for c, x in zip(columns, (
                        b, nodes[own].tobytes(), sizes[own].tobytes(),
                        local.astype(np.uint32).tobytes(),
                        # The low half stays; buckets are made from the high half.
                        (values[mine] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), flags[mine].tobytes(),
                    )):
                        c.append(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
                    [f.split()[0] for f in _SIGNATURES.split(", ")],
                )
    return run


def _joined(table: pa.Table, name: str, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]


def _match(table: pa.Table) -> pa.Table:
    """Candidate pairs (smaller set's node first) with their support, and member lists of large groups."""
    nodes, sizes = _joined(table, "nodes", np.int64), _joined(table, "sizes", np.uint32)
    owners = _joined(table, "owners", np.uint32)
    node = np.concatenate([n[o] for n, o in zip(nodes, owners)])
    size = np.concatenate([n[o] for n, o in zip(sizes, owners)]).astype(np.int64)
    sig = np.concatenate(_joined(table, "signatures", np.uint32))
    flag = np.concatenate(_joined(table, "flags", np.uint8))
    order = np.lexsort((node, sig))
    node, size, sig, flag = node[order], size[order], sig[order], flag[order]
    fresh = np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]
    at = np.flatnonzero(fresh)
    flag = np.bitwise_or.reduceat(flag, at)
    node, size, sig = node[at], size[at], sig[at]
    starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    counts = np.diff(np.r_[starts, len(sig)])
    found: list[np.ndarray] = []

    def add(i: np.ndarray, j: np.ndarray) -> None:
        si, sj = size[i], size[j]
        swap = (si > sj) | ((si == sj) & (node[i] > node[j]))
        r, s = np.where(swap, j, i), np.where(swap, i, j)
        fits = 5 * size[r] >= 4 * size[s]
        # A probe meets an entry; sets of one size may probe each other.
        meets = ((flag[s] & _PROBE) > 0) & ((flag[r] & _INDEX) > 0)
        meets |= (si == sj) & ((flag[r] & _PROBE) > 0) & ((flag[s] & _INDEX) > 0)
        ok = fits & meets & (node[r] != node[s])
        found.append(np.stack([node[r[ok]], node[s[ok]]], 1))

    few = (counts >= 2) & (counts <= GROUP)
    for step in range(1, GROUP):
        spots = [starts[few & (counts > step + k)] + k for k in range(GROUP - step)]
        i = np.concatenate(spots) if spots else np.empty(0, np.int64)
        add(i, i + step)
    large = np.flatnonzero(counts > GROUP)
    lists: dict[bytes, np.ndarray] = {}
    for g in large.tolist():
        a, n = int(starts[g]), int(counts[g])
        if not (flag[a:a + n] & _PROBE).any():
            continue
        members = np.arange(a, a + n)
        add(np.full(n - 1, a), members[1:])
        add(np.full(n - 1, a + n - 1), members[:-1])
        lists.setdefault(xxhash.xxh3_128_digest(node[a:a + n].tobytes()), node[a:a + n])
    pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
    if len(pairs):
        pairs, support = np.unique(pairs, axis=0, return_counts=True)
    else:
        support = np.empty(0, np.int64)
    k = len(lists)
    return pa.table({
        "a": pa.array(pairs[:, 0].tolist() + [None] * k, pa.int64()),
        "b": pa.array(pairs[:, 1].tolist() + [None] * k, pa.int64()),
        "support": pa.array(support.tolist() + [None] * k, pa.int64()),
        "members": pa.array([None] * len(pairs) + [m.tolist() for m in lists.values()], pa.list_(pa.int64())),
    })


def _common(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose profiles differ in no more segments than linked sets can."""
    maker = Signatures()
    for batch in (b.slice(at, 2000) for b in batches for at in range(0, len(b), 2000)):
        good = []
        for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("size_a", "size_b", "left", "right"))):
            (n, x), (m, y) = sorted(((n, x), (m, y)), key=lambda p: p[0])
            at = maker.offset(m, n)
            segments = maker.band(n)[2]
            x, y = np.frombuffer(x, np.uint8, segments), np.frombuffer(y, np.uint8, segments, at)
            good.append(5 * n >= 4 * m and int((x != y).sum()) <= (n + m) // 9)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 200) for b in batches for at in range(0, len(b), 200)):
        good = []
        for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            good.append(links(len(x), len(y), _common(x, y)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs a, b whose whole sets are linked. Profiles, a byte per segment, spare most of the others the trip."""

    def side(name: str, what: str, column: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("size").alias(f"size_{name}"), F.col(column).alias(what))

    maybe = pairs.select("a", "b").join(side("a", "left", "profile"), "a").join(side("b", "right", "profile"), "b")
    maybe = checkpointed(maybe.mapInArrow(_maybe, "a long, b long"))
    whole = maybe.join(side("a", "left", "hashes"), "a").join(side("b", "right", "hashes"), "b")
    return whole.mapInArrow(_verify, "a long, b long")


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, size, hash: one row for each hash of a set."""
    for batch in batches:
        for node, raw in zip(batch.column("node").to_pylist(), batch.column("hashes").to_pylist()):
            s = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(s), node)), pa.array(np.full(len(s), len(s))), pa.array(s)], ["node", "size", "hash"])


def prefix_groups(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """group, node: sets that share a hash among their rarest ones.

    In one order of all hashes, rare ones first, two linked sets share one of the first
    size - ceil(0.8 x size) + 1 of each. What only comes with a common passage stands at the end.
    """
    opened = checkpointed(
        sets.join(nodes, "node", "left_semi").select("node", "hashes").mapInArrow(_prefixes, "node long, size long, hash long"))
    counts = opened.groupBy("hash").count()
    order = Window.partitionBy("node").orderBy("count", "hash")
    ranked = opened.join(counts, "hash").withColumn("n", F.row_number().over(order))
    kept = ranked.where("n <= size - ceil(4 * size / 5) + 1 and count > 1")
    return kept.select(F.col("hash").alias("group"), "node")


def _block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between the asked members of a group and one block of its members, by counting over a local index."""
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        names = right.column("node").to_numpy()
        comps = right.column("component").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in right.column("hashes").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], np.repeat(np.arange(len(sets)), sizes)[order]
        for node, comp, raw in zip(*(left.column(c).to_pylist() for c in ("node", "component", "hashes"))):
            s = np.frombuffer(raw, np.uint64)
            a, b = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            spots = np.repeat(a, b - a) + (np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a))
            common = np.bincount(owner[spots], minlength=len(sets))
            good = (100 * common >= 80 * (sizes + len(s) - common)) & (comps != comp)
            # One link into each other component is enough.
            _, firsts = np.unique(comps[good], return_index=True)
            out += [(node, n) for n in names[good][firsts].tolist()]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _labelled(frame: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """The frame with the component of a node; a node without links is its own."""
    named = labels.select(F.col("node").alias(column), "component")
    return frame.join(named, column, "left").withColumn("component", F.coalesce("component", column))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    ends = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    others = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    return pairs.join(ends, "a", "left").join(others, "b", "left").where(
        F.coalesce("ca", "a") != F.coalesce("cb", "b")
    ).drop("ca", "cb")


def _open_groups(members: DataFrame, labels: DataFrame) -> DataFrame:
    """group, node, component, main (the group's largest component) of groups in several components."""
    placed = _labelled(members, "node", labels)
    counted = placed.groupBy("group", "component").agg(F.count(F.lit(1)).alias("n"))
    mains = counted.groupBy("group").agg(
        F.max(F.struct("n", "component")).getField("component").alias("main"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1")
    return placed.join(mains.select("group", "main"), "group")


#: Bits of the table that says which rows' sets are wanted: 8 MB, whatever the number of rows.
WANTED_BITS = 1 << 26


def _wanted_rows(keys: DataFrame) -> bytes:
    """One bit for each hash of a key, as a table of fixed size."""
    number = F.pmod(F.xxhash64("key"), F.lit(WANTED_BITS)) + 1
    rows = keys.select(number.alias("number")).groupBy(F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))
    bits = bytearray(WANTED_BITS // 8)
    for row in rows.collect():
        start = (row["bucket"] - 1) * 4096
        bits[start:start + 4096] = row["bits"]
    return bytes(bits)


_ROW_KEY = "key struct<no_id:boolean,id:long,text:long>"


def _row_key():
    """Id and text of a row, never null; rows without an id come last."""
    return F.struct(
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("text"))


def near_links(df: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, node, key) and enough verified links (a, b) for all components of the sets."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist())
            nodes = [short(digest(s)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(nodes, pa.int64()), batch.column("key")],
                ["doc_id", "n_shingles", "node", "key"],
            )

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Signatures()
        table = np.frombuffer(bits, np.uint8)
        wanted_only = (b.filter(pa.array(table[at >> 3] >> (at & 7) & 1 == 1)) for b in batches
                       for at in [b.column("at").to_numpy()])
        for batch in slices(wanted_only, "text", BATCH_BYTES):
            sets = [s for s in shingle_sets(batch.column("text").to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([short(digest(s)) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([maker.profile(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "size", "profile", "hashes"],
            )

    shaped = pick(df, doc_id=id, text=text).withColumn("key", _row_key())
    rows = checkpointed(shaped.mapInArrow(describe, f"doc_id long, n_shingles long, node long, {_ROW_KEY}"))
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // BUCKET)
    found = checkpointed(
        shaped.select("text").mapInArrow(_emit_signatures(buckets), _SIGNATURES)
        .groupBy("bucket").applyInArrow(lambda t: _match(t.drop(["bucket"])), _FOUND)
    )
    # A pair is found in each bucket where it shares a signature: it is made one before anything is done with it.
    pairs = found.where("a is not null").groupBy("a", "b").agg(F.sum("support").alias("support"))
    best = Window.partitionBy("b").orderBy(F.desc("support"), "a")
    pairs = checkpointed(pairs.withColumn("n", F.row_number().over(best)))
    groups = found.where("members is not null").select(
        F.xxhash64("members").alias("group"), "members").dropDuplicates(["group"])
    groups = checkpointed(groups.select("group", F.explode("members").alias("node")))
    # Whole sets of the candidates only. A row of each class is chosen by its key; a second pass over the texts
    # makes the chosen rows' sets where they lie, so that no text travels. The few rows that the bit table lets
    # through by chance go with the exact join after it.
    wanted = checkpointed(
        pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(groups.select("node")).distinct())
    chosen = rows.groupBy("node").agg(F.min("key").alias("key")).join(wanted, "node", "left_semi")
    bits = _wanted_rows(chosen)
    texts = shaped.select("text", F.pmod(F.xxhash64("key"), F.lit(WANTED_BITS)).alias("at"))
    sets = checkpointed(
        texts.mapInArrow(sets_of, "node long, size long, profile binary, hashes binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    )
    # Round 1: each set's best supported pair, then all pairs not yet within one component.
    known = checkpointed(verified(pairs.where("n = 1"), sets))
    labels = components(known)
    known = checkpointed(known.unionByName(verified(_apart(pairs.where("n > 1"), labels), sets)))
    # Large groups in several components: only what also shares a rare hash can be linked.
    labels = components(known)
    opened = checkpointed(_open_groups(groups, labels))
    if opened.isEmpty():
        return rows, known
    groups = prefix_groups(opened.select("node").distinct(), sets)
    opened = checkpointed(_open_groups(groups, labels))
    if opened.isEmpty():
        return rows, known
    # Round 2: members outside a group's largest component with a few partners each.
    opened = opened.join(sets.select("node", "size"), "node")
    seats = opened.withColumn("seat", F.row_number().over(Window.partitionBy("group").orderBy("node")) - 1)
    members = seats.groupBy("group").agg(F.count(F.lit(1)).cast("int").alias("members"))
    chance = F.transform(F.sequence(F.lit(1), F.lit(PARTNERS)),
                         lambda i: F.pmod(F.xxhash64("node", "group", i), F.col("members")).cast("int"))
    everyone = F.sequence(F.lit(0), F.least("members", F.lit(MEET_ALL)) - 1)
    asked = seats.where(F.col("component") != F.col("main")).join(members, "group").select(
        "group", F.col("node").alias("a"), F.col("size").alias("size_a"),
        F.explode(F.when(F.col("members") <= MEET_ALL, everyone).otherwise(chance)).alias("seat"))
    others = seats.select("group", "seat", F.col("node").alias("b"), F.col("size").alias("size_b"))
    fits = 5 * F.least("size_a", "size_b") >= 4 * F.greatest("size_a", "size_b")
    tried = asked.join(others, ["group", "seat"]).where(fits & (F.col("a") != F.col("b"))).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    known = checkpointed(known.unionByName(verified(_apart(tried, labels), sets)))
    # Round 3: what is still outside, against its whole group in blocks.
    labels = components(known)
    large = opened.join(members.where(F.col("members") > MEET_ALL), "group").select("group", "node")
    opened = checkpointed(_open_groups(large, labels))
    if opened.isEmpty():
        return rows, known
    members = opened.join(sets.drop("profile", "size"), "node")
    spread = F.pmod(F.xxhash64("node"), F.col("blocks"))
    blocks = opened.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    members = members.join(blocks, "group")
    asking = members.where(F.col("component") != F.col("main")).select(
        "group", "node", "component", "hashes", spread.alias("row"), "blocks"
    ).select("group", "node", "component", "hashes", "row",
             F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("col"))
    asked = members.select("group", "node", "component", "hashes", spread.alias("col"), "blocks").select(
        "group", "node", "component", "hashes", "col",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("row"))
    # Fresh names on one side: both sides come from the same table.
    asked = asked.select(*[F.col(c).alias(c) for c in asked.columns])
    keys = ["group", "row", "col"]
    more = asking.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_block_links, "a long, b long")
    return rows, checkpointed(known.unionByName(more))


def jaccard_components(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, known = near_links(df, id, text)
    labelled = _labelled(rows, "node", components(known))
    least = labelled.where("node is not null").groupBy("component").agg(F.min("doc_id").alias("first_id"))
    return labelled.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("first_id", "doc_id").alias("component_id"))


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def first_of_each(df: DataFrame) -> DataFrame:
    """The rows of a documents table that are the first of their component, one row of it.

    A row is known by its id and text, so rows that repeat an id or have none are decided by their own
    components. Texts without a word are no copies of each other; only repeated rows of them go.
    """
    rows, known = near_links(df)
    labelled = _labelled(rows, "node", components(known))
    firsts = labelled.where("node is not null").groupBy("component").agg(F.min("key").alias("key")).select("key")
    firsts = firsts.unionByName(rows.where("node is null").select("key").distinct())
    whole = df.select(_row_key().alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    kept = whole.join(firsts, "key", "left_semi")
    # Maps have no hash; their JSON stands for them.
    ties = [F.col("row").getField(f.name) for f in df.schema]
    ties = [F.xxhash64(F.to_json(F.struct(t)) if "map<" in f.dataType.simpleString() else t)
            for t, f in zip(ties, df.schema)]
    nth = F.row_number().over(Window.partitionBy("key").orderBy(*ties))
    once = kept.withColumn("nth", nth).where("nth = 1")
    return once.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
