"""Cross-site line dedup: lines that stand on many sites are boilerplate.

Every line, trimmed of white space, gets a 128-bit hash. Its spread is its number of distinct sites,
estimated by a HyperLogLog sketch per hash that is built in the map tasks and merged by the
aggregation; so a line that all documents share is one small sketch per task. Lines whose estimate is
near the threshold (within BAND) get an exact distinct count over the lines that need it alone. A
boilerplate line stays in the document of smallest id that has it and goes from all others, so no
content is lost altogether.

Defined cases: blank lines are no boilerplate; null text stays null with 0 lines; null sites do not
count as sites; a null id is larger than any other; a line repeated within one document counts once
and stays or goes as one; rows equal in id and text are treated alike; other columns are kept as they
are by ``without_boilerplate``, whatever their names.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from norrsken.llm.common import checkpointed, documents

#: Sites from which on a line is boilerplate.
MIN_SITES = 10
#: Sketch size (2**LG_K registers: 1.6 % standard error) and the band that is counted exactly, six times that.
LG_K = 12
BAND = 0.1

_LARGEST = (1 << 63) - 1


def _line_hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def lines(df: DataFrame, id: str, text: str, site: str) -> DataFrame:
    """doc, tag, site, place, h1, h2 of each line that is not blank. (doc, tag) names a row's content."""
    opened = df.select(
        F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_LARGEST)).alias("doc"),
        F.xxhash64(F.col(f"`{text}`")).alias("tag"),
        F.col(f"`{site}`").cast("string").alias("site"),
        F.posexplode(F.split(F.col(f"`{text}`"), "\n")).alias("place", "line"),
    ).withColumn("line", F.btrim("line", F.lit(" \t\r")))
    return opened.where("line <> ''").select("doc", "tag", "site", "place", *_line_hashes(F.col("line")))


def boilerplate(spread_of: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first_doc of the lines that stand on at least ``min_sites`` sites."""
    sketched = checkpointed(
        spread_of.groupBy("h1", "h2").agg(
            F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("estimate"),
            F.min("doc").alias("first_doc"),
        ).where(F.col("estimate") >= min_sites * (1 - BAND))
    )
    clear = sketched.where(F.col("estimate") > min_sites * (1 + BAND))
    near = sketched.where(F.col("estimate") <= min_sites * (1 + BAND))
    exact = (
        spread_of.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi")
        .distinct().groupBy("h1", "h2").agg(F.count("site").alias("sites"))
        .where(F.col("sites") >= min_sites).select("h1", "h2")
    )
    return clear.select("h1", "h2", "first_doc").unionByName(
        near.join(exact, ["h1", "h2"]).select("h1", "h2", "first_doc"))


def _marked(df: DataFrame, id: str, text: str, site: str, min_sites: int) -> DataFrame:
    """The rows as struct ``row`` with doc, tag and the sorted places of their lines that go."""
    opened = lines(df, id, text, site)
    common = boilerplate(opened, min_sites)
    going = (
        opened.select("doc", "tag", "place", "h1", "h2").join(common, ["h1", "h2"])
        .where(F.col("doc") != F.col("first_doc"))
        .groupBy("doc", "tag").agg(F.array_sort(F.collect_set("place")).alias("places"))
    )
    rows = df.select(
        F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(_LARGEST)).alias("doc"),
        F.xxhash64(F.col(f"`{text}`")).alias("tag"),
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
    )
    return rows.join(going, ["doc", "tag"], "left")


def _clean(text: Column, places: Column) -> Column:
    """The text without the lines at the sorted places: slices between them, in one pass over each list."""
    parts = F.split(text, "\n")
    edges = F.concat(F.array(F.lit(-1)), places)
    kept = F.flatten(F.transform(edges, lambda p, i: F.slice(
        parts, p + 2, F.greatest(F.lit(0), F.coalesce(F.get(edges, i + 1), F.size(parts)) - p - 1))))
    return F.when(places.isNull(), text).otherwise(F.array_join(kept, "\n"))


def line_dedup(df: DataFrame, id: str = "doc_id", text: str = "text", site: str = "source",
               min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, n_lines, n_removed, clean_text of every row."""
    marked = _marked(df, id, text, site, min_sites)
    whole = F.col("row").getField(text)
    n_lines = F.when(whole.isNull(), F.lit(0)).otherwise(F.size(F.split(whole, "\n")))
    return marked.select(
        F.col("row").getField(id).alias("doc_id"), n_lines.cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), F.lit(0)).otherwise(F.size("places")).cast("long").alias("n_removed"),
        _clean(whole, F.col("places")).alias("clean_text"),
    )


def without_boilerplate(df: DataFrame, id: str = "doc_id", text: str = "text", site: str = "source",
                        length: str = "n_chars", min_sites: int = MIN_SITES) -> DataFrame:
    """The rows with cleaned text under the same columns, ``length`` brought up to date.

    A document that has lost all its content (only white space is left) goes: each of its lines stays in another one.
    """
    marked = _marked(df, id, text, site, min_sites)
    changed = F.col("places").isNotNull()
    cleaned = marked.withColumn("clean", _clean(F.col("row").getField(text), F.col("places")))
    kept = cleaned.where(~changed | (F.btrim("clean", F.lit(" \t\r\n")) != ""))
    out = {text: F.col("clean"),
           length: F.when(changed, F.length("clean").cast("long")).otherwise(F.col("row").getField(length))}
    return kept.select(*[out.get(c, F.col("row").getField(c)).alias(c) for c in df.columns])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


ORACLE = f"""
with opened as (
  select doc_id, text, source, unnest(string_split(text, chr(10))) raw,
         unnest(range(len(string_split(text, chr(10))))) place
  from documents
), lines as (
  select *, trim(raw, ' ' || chr(9) || chr(13)) line from opened
), common as (
  select line, min(coalesce(doc_id, {_LARGEST})) first_doc from lines where line <> ''
  group by line having count(distinct source) >= {MIN_SITES}
), judged as (
  select l.doc_id, l.text, l.place, l.raw,
         c.line is not null and coalesce(l.doc_id, {_LARGEST}) <> c.first_doc gone
  from lines l left join common c using (line)
)
select doc_id, count(*)::bigint n_lines, count(*) filter (gone)::bigint n_removed,
       coalesce(string_agg(raw, chr(10) order by place) filter (not gone), '') clean_text
from judged group by doc_id, text
"""
