"""Market context per day from a stream of quotes, with open days visible and replaced as quotes come in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from norrsken.operators.scorecard import is_active, is_mover, is_selloff, market_tone

#: Groups that the companies of a day are dealt to, so that no day is one task.
DAY_BUCKETS = 16

COUNTS = ("companies", "positive_movers", "selloffs", "active_turnover")
_FLAGS = ("counted", "mover", "selloff", "active")
CONTEXT = ("snapshot_date date, bucket long, " + ", ".join(f"{n} long" for n in COUNTS) + ", closed boolean")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DayContext(StatefulProcessor):
    """Last quote of each company of a (day, bucket), and the counts over them.

    Every batch that touches a group puts out its new counts. An event-time timer at the day's end, which fires once
    the watermark has passed it, puts the final counts out and drops the group's state. Later quotes of a
    closed day are ignored.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getMapState(
            "last", "ticker string, country string", "at timestamp, rank string, " + ", ".join(f"{n} int" for n in _FLAGS))
        self._counts = handle.getValueState("counts", ", ".join(f"{n} long" for n in COUNTS))

    def _row(self, key: Any, counts: list[int], closed: bool) -> pd.DataFrame:
        row = {"snapshot_date": [key[0]], "bucket": [key[1]], **{n: [v] for n, v in zip(COUNTS, counts)}, "closed": [closed]}
        return pd.DataFrame(row)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        end = int(pd.Timestamp(key[0]).timestamp() * 1000) + 86_400_000
        if end <= timerValues.getCurrentWatermarkInMs():
            return
        held = self._counts.get()
        if held is None:
            self._handle.registerTimer(end)
        counts = list(held) if held is not None else [0] * len(COUNTS)
        batch = pd.concat(list(rows), ignore_index=True)
        # One row per company and batch, so that the state is asked once for each.
        newest = batch.sort_values(["ts", "rank"], kind="stable").drop_duplicates(["ticker", "country"], keep="last")
        for row in newest.itertuples(index=False):
            company, at = (row.ticker, row.country), row.ts.to_pydatetime()
            new = [int(getattr(row, n)) for n in _FLAGS]
            old = self._last.getValue(company) if self._last.containsKey(company) else None
            if old is not None and (old[0], old[1]) >= (at, row.rank):
                continue
            self._last.updateValue(company, (at, row.rank, *new))
            before = old[2:] if old is not None else [0] * len(_FLAGS)
            counts = [n + new[i] - before[i] for i, n in enumerate(counts)]
        self._counts.update(tuple(counts))
        yield self._row(key, counts, False)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self._counts.get()
        if held is not None:
            yield self._row(key, list(held), True)
        self._last.clear()
        self._counts.clear()


def stream_market_context(quotes: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Counts per day and bucket, put out anew with every batch that changes them. ``quotes`` has ts, ticker,
    country, price, currency and the two signal arrays.

    A company may be quoted many times a day and its last quote counts, as a re-run of a day replaces its
    snapshot; of quotes at the same time the greatest, so that the order of arrival does not matter. A last quote
    without price or currency takes the company out.
    """
    c = F.col
    counted = c("price").isNotNull() & c("currency").isNotNull()
    none = F.array().cast("array<string>")
    # Zero-padded digits keep the order of positive prices as text; a missing price comes first.
    rank = F.concat_ws(
        "|", F.coalesce(F.format_string("%030.9f", "price"), F.lit("")), F.coalesce("currency", F.lit("")),
        F.array_join(F.coalesce("catalysts", none), ";"), F.array_join(F.coalesce("risks", none), ";"))
    flags = {"counted": counted, "mover": counted & is_mover(), "selloff": counted & is_selloff(), "active": counted & is_active()}
    shaped = quotes.withWatermark("ts", lateness).select(
        "ts", c("ts").cast("date").alias("snapshot_date"),
        F.pmod(F.xxhash64("ticker", "country"), F.lit(DAY_BUCKETS)).alias("bucket"),
        "ticker", "country", rank.alias("rank"),
        *(F.coalesce(v, F.lit(False)).cast("int").alias(n) for n, v in flags.items()),
    )
    return shaped.groupBy("snapshot_date", "bucket").transformWithStateInPandas(
        DayContext(), outputStructType=CONTEXT, outputMode="Update", timeMode="EventTime")


def start_context_sink(
    context: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Every batch's groups under the batch's number; ``read_context`` takes the newest of each.

    A batch that is replayed replaces its own rows. The operator's state needs Spark's RocksDB store, which
    is set for this stream alone.
    """
    spark = context.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = (
        context.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    )
    earlier = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.set(_PROVIDER, earlier)


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """Counts and tone of every day seen so far; ``closed`` once no further quote can change it."""
    c = F.col
    rows = spark.read.schema(f"{CONTEXT}, batch long").option("basePath", path).parquet(path)
    counts = F.struct(*COUNTS, "closed")
    newest = rows.groupBy("snapshot_date", "bucket").agg(F.max_by(counts, F.struct("batch", "closed")).alias("r"))
    return (
        newest.groupBy("snapshot_date")
        .agg(*(F.sum(f"r.{n}").alias(n) for n in COUNTS), F.bool_and("r.closed").alias("closed"))
        .where(c("companies") > 0)
        .withColumn("tone", market_tone(c("positive_movers"), c("selloffs")))
    )
