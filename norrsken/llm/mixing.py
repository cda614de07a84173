"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Every document gets a random key out of its id. A source's documents are ordered by key, cut into
key ranges, and the ranges' word sums give each range its offset, so that the running sum of a source
needs no task that sees the whole source. The budget of a source is cut exactly: whole epochs first,
then the documents in key order until the rest of the budget is used; the last one is taken in part.

Defined cases: null text has size 0; null source is a source of its own, last in order; null ids and
repeated rows take part like all others (equal keys are ordered by id, then by a hash of the text). Without words every target is 0 and nothing is taken. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from norrsken.llm.common import WHITE, documents, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source is read more often than this.
MAX_EPOCHS = 3
#: Rows of all sources for each key range; the number of ranges is bounded, so that their sums are few.
ROWS_PER_RANGE = 1000
MAX_RANGES = 65536


def source_targets(sizes: DataFrame) -> DataFrame:
    """part, source, source_size -> target, by filling up in proportion to the weights below 3 x size.

    Sources sorted by size over weight reach their ceiling in that order; a source is at its ceiling
    when what the earlier ones leave would lift it above. One row per source, so these windows are small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), (place + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("ceiling", F.col("source_size") * MAX_EPOCHS)
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(
        F.col("ceiling") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0))
    # Exact in integers: the source is full if ceiling / weight <= left / (weights from it on).
    full = F.col("ceiling") * F.sum("weight").over(after) <= left * F.col("weight")
    marked = weighed.withColumn("full", full)
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    open_size = F.sum("source_size").over(everything) - F.coalesce(
        F.sum(F.when(F.col("full"), F.col("ceiling"))).over(everything), F.lit(0)
    )
    share = (F.col("weight") * open_size).cast("double") / open_weight.cast("double")
    target = F.when(F.col("full"), F.col("ceiling").cast("double")).otherwise(share)
    return marked.select("part", "source", "source_size", target.alias("target"))


def _taken(size: Column, before: Column, budget: Column, total: Column) -> Column:
    epochs = F.when(total > 0, F.floor(budget / total)).otherwise(0).cast("long")
    rest = budget - epochs * total
    partial = F.greatest(F.lit(0).cast("long"), F.least(size, rest - before))
    return epochs * size + partial


def mixed(df: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
          carry: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken (long: words the mix takes, repeats counted).

    The cut is at floor(target) words of each source. ``carry`` adds the input row as struct ``row``.
    """
    number = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))
    shaped = df.select(
        F.col(f"`{id}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        # Never null, so that windows and joins below use one and the same shuffle.
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("part"),
        word_count(F.col(f"`{text}`")).alias("size"),
        F.md5(number).alias("key"),
        F.xxhash64(F.col(f"`{text}`")).alias("tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []),
    )
    # One small job: the number of rows fixes how finely keys are cut.
    rows = df.select(F.count(F.lit(1)).alias("n")).first()["n"]
    ranges = min(MAX_RANGES, max(64, rows // ROWS_PER_RANGE))
    digits = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    shaped = shaped.withColumn("range", F.floor(digits * ranges / F.lit(2**32)).cast("int"))
    sums = shaped.groupBy("part", "range").agg(
        F.sum("size").alias("range_size"), F.min("source").alias("source")
    )
    within = Window.partitionBy("part").orderBy("range")
    offsets = sums.select(
        "part", "range",
        (F.sum("range_size").over(within) - F.col("range_size")).alias("range_before"),
    )
    sizes = sums.groupBy("part").agg(
        F.sum("range_size").alias("source_size"), F.min("source").alias("source")
    )
    placed = offsets.join(source_targets(sizes), "part")
    # Rows with the same id (or none) share a key; the tie hash keeps their order.
    running = Window.partitionBy("part", "range").orderBy(
        "key", F.col("doc_id").asc_nulls_last(), "tie"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = shaped.withColumn("running", F.sum("size").over(running) - F.col("size"))
    before = F.col("running") + F.col("range_before")
    taken = _taken(F.col("size"), before, F.floor("target").cast("long"), F.col("source_size"))
    joined = summed.join(placed.drop("source"), ["part", "range"])
    return joined.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), *(["row"] if carry else [])
    )


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir))


def mixed_documents(df: DataFrame) -> DataFrame:
    """The rows of a documents table in the amounts of the mix, under the same columns.

    A row comes once for each whole epoch, and once more with the part taken last: its first words
    and the white space between them, with ``n_chars`` to match.
    """
    amounts = mixed(df, carry=True)
    whole = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    repeats = F.concat(
        F.array_repeat(F.lit(0), whole),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")),
    )
    opened = amounts.select("row", F.explode(repeats).alias("words"))
    steps = F.split(F.col("row.text"), f"(?<=[^{WHITE}])(?=[{WHITE}])")
    entire = F.col("words") == 0
    text = F.when(entire, F.col("row.text")).otherwise(F.array_join(F.slice(steps, 1, F.greatest("words", F.lit(1))), ""))
    out = {"text": text, "n_chars": F.when(entire, F.col("row.n_chars")).otherwise(F.length(text).cast("long"))}
    return opened.select(*[out.get(c, F.col(f"row.`{c}`")).alias(c) for c in df.columns])


ORACLE = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size,
         md5(coalesce(doc_id::varchar, '')) k
  from documents
), sources as (
  select source, sum(size)::bigint source_size from sized group by source
), weighed as (
  select *, [1, 2, 3][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] weight,
         3 * source_size ceiling
  from sources
), marked as (
  select *, ceiling * sum(weight) over (order by ceiling / weight, source nulls last
                                        rows between current row and unbounded following)
            <= weight * (sum(source_size) over () - coalesce(sum(ceiling) over (
                 order by ceiling / weight, source nulls last
                 rows between unbounded preceding and 1 preceding), 0)) is_full
  from weighed
), targets as (
  select source, source_size, case when is_full then ceiling::double
         else (weight * (sum(source_size) over () - coalesce(sum(ceiling) filter (is_full) over (), 0)))::double
              / (sum(weight) filter (not is_full) over ())::double end target
  from marked
), placed as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint budget,
         (sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls last
                            rows unbounded preceding) - d.size)::bigint before_it
  from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
       (case when source_size > 0 then budget // source_size else 0 end * size
        + greatest(0, least(size, budget - case when source_size > 0 then budget // source_size else 0 end
                                 * source_size - before_it)))::bigint taken
from placed
"""
