"""Merkle manifest of a dataset: one tree per source, one tree over the sources, a proof for every row.

Leaves of a source are numbered by id in one range sort and prefix sums over its parts, so that no task
sees a whole source. The tree then rises by lag and lead windows: a node lives on the row of its first
leaf; at level k the columns at offsets of 3**k and 2 * 3**k rows, masked by the node's slot and its run's
length, are its siblings, and first-child rows hash their parent. Runs of FANOUT**LEVELS leaves never cross
a block, so all levels of a block share one shuffle and one sort; the blocks' roots are the leaves of the
next round. Proofs go down by the same windows: each row takes the siblings of the last node row at or
before it.

Defined cases: null values are hashed as ``-``; null ids come first within their source and are not
tampered with; a null source is a source of its own and comes first; rows equal in all hashed columns are
leaves of their own next to each other; rows of one id are ordered by their leaf; an empty table has no rows
and no root; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from norrsken.llm.common import checkpointed, documents, pick

FANOUT = 3
#: Levels within a block: runs up to FANOUT ** LEVELS (6,561) leaves are one window group.
LEVELS = 8
#: Rows of a part of the range sort.
ROWS_PER_PART = 16_384

#: A level of a proof: digests to the left and to the right of the path, each as one text.
STEP = "struct<left:string,right:string>"


def _field(value: Column) -> Column:
    """Length-prefixed text of a value, or ``-``."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest_of(*values: Column) -> Column:
    """Digest of a row's values in order."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` with ``place`` (0, 1, ... within ``part_of``) and ``total`` of their group.

    Rows are range-sorted by group, then by the columns of ``rank``, then by ``seq``, which tells equal rows
    apart. A group's place is its row within a sorted part, plus what earlier parts hold of the group.
    """
    rows = leaves.count()
    by = [F.col("part_of").asc_nulls_first(), F.col("rank").asc_nulls_first(), F.col("seq").asc()]
    ranged = leaves.repartitionByRange(max(1, -(-rows // ROWS_PER_PART)), *by).sortWithinPartitions(*by)
    # Row numbers of a sorted part: the id's lower bits count rows, its upper bits are the part.
    ordered = checkpointed(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn(
        "part", F.shiftright("at", 33)))
    runs = ordered.groupBy("part_of", "part").agg(F.count(F.lit(1)).alias("held"), F.min("at").alias("first_at"))
    earlier = Window.partitionBy("part_of").orderBy("part")
    runs = runs.select(
        "part_of", "part",
        (F.sum("held").over(earlier) - F.col("held") - F.col("first_at")).alias("shift"),
        F.sum("held").over(Window.partitionBy("part_of")).alias("total"),
    )
    placed = ordered.join(runs, ["part_of", "part"])
    return placed.withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _risen(nodes: DataFrame) -> DataFrame:
    """``nodes`` (part_of, place, total, node) with ``block``, ``steps`` up to the block's root, and that ``root``.

    A group of one node has no step.
    """
    c = F.col
    block = F.floor(c("place") / F.lit(FANOUT ** LEVELS)).cast("long")
    df = nodes.withColumn("block", block)
    rows = Window.partitionBy("part_of", "block").orderBy("place")
    digest = "node"
    for level in range(LEVELS):
        width = FANOUT ** level
        at, count = F.floor(c("place") / F.lit(width)), F.ceil(c("total") / F.lit(width))
        slot = (at % FANOUT).cast("int")
        run = F.least(F.lit(FANOUT), count - (at - at % FANOUT))
        head = c("place") % width == 0
        near = {f"_{name}{k}": move(digest, k * width).over(rows)
                for name, move in (("before", F.lag), ("after", F.lead)) for k in (1, 2)}
        df = df.withColumns({"_slot": slot, "_run": run, **near})
        left = F.when(c("_slot") == 2, F.concat("_before2", "_before1")).when(c("_slot") == 1, c("_before1")).otherwise("")
        right = (
            F.when(c("_slot") + 2 < c("_run"), F.concat("_after1", "_after2"))
            .when(c("_slot") + 1 < c("_run"), c("_after1")).otherwise("")
        )
        going = count > 1  # several nodes remain in the group, so this level exists
        parent = F.when(going, F.sha2(F.concat(c(digest), c("_right")), 256)).otherwise(c(digest))
        up = c("place") % (width * FANOUT) == 0
        df = (
            df.withColumns({"_left": left, "_right": right})
            .withColumns({
                f"_step{level}": F.when(head, F.struct(
                    going.alias("is"), c("_left").alias("left"), c("_right").alias("right"))),
                f"_node{level + 1}": F.when(up, parent),
            })
            .drop("_slot", "_run", "_left", "_right", *near)
        )
        digest = f"_node{level + 1}"
    # Down again: the last node row at or before a row is its ancestor's, at every level.
    down = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = {f"_step{k}": F.last(f"_step{k}", ignorenulls=True).over(down) for k in range(LEVELS)}
    df = df.withColumns({**held, "root": F.first(digest).over(down)})
    steps = F.transform(
        F.filter(F.array(*[c(n) for n in held]), lambda s: s["is"]),
        lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right")),
    )
    return df.withColumn("steps", steps).drop(*held, *[f"_node{k + 1}" for k in range(LEVELS)])


def trees(nodes: DataFrame, most: int) -> DataFrame:
    """``nodes`` (part_of, place, total, node) with ``steps`` from each node to its group's ``root``.

    ``most`` is the largest group's number of nodes: it says how many rounds of blocks the tree takes.
    """
    c = F.col
    risen = _risen(nodes)
    if most <= FANOUT ** LEVELS:
        return risen.drop("block")
    risen = checkpointed(risen)
    heads = risen.where(c("place") % FANOUT ** LEVELS == 0).select(
        "part_of", c("block").alias("place"),
        F.ceil(c("total") / F.lit(FANOUT ** LEVELS)).cast("long").alias("total"), c("root").alias("node"),
    )
    above = trees(heads, -(-most // FANOUT ** LEVELS)).select(
        "part_of", c("place").alias("block"), c("steps").alias("_above"), c("root").alias("_top"))
    return risen.join(above, ["part_of", "block"]).select(
        *[n for n in risen.columns if n not in ("block", "steps", "root")],
        F.concat("steps", "_above").alias("steps"), c("_top").alias("root"))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and a proof's steps lead to."""
    return F.aggregate(steps, leaf, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """One digest of all siblings, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(df: DataFrame, columns: list[str], id: str = "doc_id", source: str = "source",
             extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root and ``steps`` (the proof: left and right siblings by level) of every row.

    ``columns`` are hashed in order. ``extra`` adds columns made out of the input's own, computed in the same pass.
    """
    c = F.col
    # Never null, so that joins by group need no null-safe comparison; null sorts before all others.
    group = F.coalesce(F.concat(F.lit("="), c(f"`{source}`").cast("string")), F.lit(""))
    leaves = checkpointed(df.select(
        c(f"`{id}`").alias("doc_id"), group.alias("part_of"),
        digest_of(*[c(f"`{n}`") for n in columns]).alias("node"),
        *[value.alias(name) for name, value in (extra or {}).items()],
        F.monotonically_increasing_id().alias("seq"),
    ))
    ranked = leaves.withColumn("rank", F.struct("doc_id", "node"))
    placed = numbered(ranked).drop("rank", "seq")
    # One row comes back: the size of the largest group, which fixes the number of rounds.
    sizes = leaves.groupBy("part_of").count()
    facts = sizes.agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("groups")).first()
    if not facts["groups"]:
        return leaves.select(
            "doc_id", *(extra or {}), c("node").alias("leaf"), c("node").alias("subroot"), c("node").alias("root"),
            F.array().cast(f"array<{STEP}>").alias("steps"))
    within = checkpointed(trees(placed, facts["most"]).withColumnsRenamed({"root": "subroot", "node": "leaf"}))
    subroots = within.where("place = 0").select(
        F.lit("").alias("part_of"), c("part_of").alias("rank"), c("subroot").alias("node"), F.lit(0).alias("seq"))
    across = trees(numbered(subroots).drop("seq"), facts["groups"]).select(
        c("rank").alias("part_of"), c("steps").alias("_across"), "root")
    return within.join(across, "part_of").select(
        "doc_id", *(extra or {}), "leaf", "subroot", "root", F.concat("steps", "_across").alias("steps"))


HASHED = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every row's leaf, roots and proof; rows with an even checksum of their id are verified after tampering."""
    c = F.col
    df = pick(documents(spark, sf_dir), **{n: n for n in HASHED})
    tampering = F.crc32(c("doc_id").cast("string")) % 2 == 0
    text = F.when(F.coalesce(tampering, F.lit(False)), F.replace(c("text"), F.lit("\n"), F.lit(""))).otherwise(c("text"))
    held = digest_of(*[text if n == "text" else c(n) for n in HASHED])
    rows = manifest(df, HASHED, extra={"held_leaf": held}).withColumn(
        "folded_root", folded(c("held_leaf"), c("steps")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(c("steps")).alias("proof_sha256"),
        "folded_root", (c("folded_root") == c("root")).alias("verified"),
    )


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


_CRC = """list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda ch: ascii(ch)::bigint),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"""

ORACLE = f"""
with recursive rows as (
  select doc_id, coalesce('=' || source, '') grp, text, source, lang, n_chars,
         sha256({' || '.join(_sql_field(n) for n in HASHED)}) leaf,
         coalesce((xor({_CRC}, 4294967295) & 1) = 0, false) tampered
  from documents
), leaves as (
  select doc_id, grp, leaf,
         case when tampered then sha256({' || '.join(_sql_field("replace(text, chr(10), '')" if n == "text" else n) for n in HASHED)})
              else leaf end held,
         row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 place,
         count(*) over (partition by grp) total
  from rows
), nodes as (
  select 0 lvl, grp, place, total, leaf digest from leaves
  union all
  select lvl + 1, grp, place // 3, (total + 2) // 3, sha256(string_agg(digest, '' order by place))
  from nodes where total > 1 group by lvl, grp, place // 3, total
), tops as (
  select grp, digest, row_number() over (order by grp) - 1 place, count(*) over () total from nodes where total = 1
), upper_nodes as (
  select 0 lvl, place, total, digest from tops
  union all
  select lvl + 1, place // 3, (total + 2) // 3, sha256(string_agg(digest, '' order by place))
  from upper_nodes where total > 1 group by lvl, place // 3, total
), inner_steps as (
  select l.grp, l.place, n.lvl,
         coalesce(string_agg(n.digest, '' order by n.place) filter (n.place < l.place // (3 ** n.lvl)::bigint), '') lft,
         coalesce(string_agg(n.digest, '' order by n.place) filter (n.place > l.place // (3 ** n.lvl)::bigint), '') rgt
  from leaves l join nodes n on n.grp = l.grp and n.total > 1 and n.place // 3 = l.place // (3 ** (n.lvl + 1))::bigint
  group by l.grp, l.place, n.lvl
), outer_steps as (
  select t.grp, n.lvl,
         coalesce(string_agg(n.digest, '' order by n.place) filter (n.place < t.place // (3 ** n.lvl)::bigint), '') lft,
         coalesce(string_agg(n.digest, '' order by n.place) filter (n.place > t.place // (3 ** n.lvl)::bigint), '') rgt
  from tops t join upper_nodes n on n.total > 1 and n.place // 3 = t.place // (3 ** (n.lvl + 1))::bigint
  group by t.grp, n.lvl
), paths as (
  select l.grp, l.place, list(s.lft || '|' || s.rgt order by s.lvl) steps
  from leaves l join (
    select grp, place, lvl, lft, rgt from inner_steps
    union all select l.grp, l.place, 1000 + o.lvl, o.lft, o.rgt from leaves l join outer_steps o using (grp)
  ) s using (grp, place) group by l.grp, l.place
), proved as (
  select l.*, coalesce(p.steps, []) steps, t.digest subroot,
         (select digest from upper_nodes where total = 1) root
  from leaves l left join paths p using (grp, place) join tops t using (grp)
), refolded as (
  select *, list_reduce([held] || steps,
         lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) folded_root
  from proved
)
select doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) proof_sha256,
       folded_root, folded_root = root verified
from refolded
"""
