"""The ledger: picks, outcomes and snapshots in one versioned folder.

A run writes new files next to the old ones, one folder for each table, run and day, and changes nothing
that is there. Last it publishes a manifest: which folders hold each day of each table. Readers take the
newest manifest, or the one they are pinned to, so they see all tables as of one run; a run that fails on
the way leaves files that no manifest names. A second run that started from the same manifest cannot
publish over the first.

Outcomes live in two tables. ``open`` holds what has no result yet, by due day; ``settled`` the rest. A run
finds what is due from the manifest's days alone, moves those days' rows to ``settled`` and drops the
days from ``open``; final rows are never read or written again.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from norrsken import constants as K
from norrsken.functions.dates import weekday_after
from norrsken.operators.outcomes import market_snapshot, open_outcomes, settle
from norrsken.operators.scorecard import TALLIES, return_tallies
from norrsken.schemas import OUTCOMES, PICKS, SNAPSHOTS, conform
from norrsken.session import checkpointed, sorted_side

#: Table -> columns and the day it is cut by.
TABLES: dict[str, tuple[StructType, str]] = {
    "picks": (PICKS, "report_date"),
    "open": (OUTCOMES, "due_date"),
    "settled": (OUTCOMES, "due_date"),
    "snapshots": (SNAPSHOTS, "snapshot_date"),
    "tallies": (TALLIES, "due_date"),
}


def merge_picks(existing: DataFrame, incoming: DataFrame, priced: DataFrame) -> DataFrame:
    """Incoming picks replace existing ones of the same id.

    Price, currency and time of entry stay as they were once any outcome of the pick is priced.
    ``priced`` holds the ids (with report date) of such picks.
    """
    c = F.col
    keys = ["report_date", "pick_id"]
    entry = ("entry_price", "entry_currency", "entry_timestamp")
    locked = priced.select(*keys).distinct().withColumn("locked", F.lit(True))
    old = existing.join(sorted_side(locked), keys, "left").select(
        *keys, F.lit(True).alias("was_there"), F.coalesce("locked", F.lit(False)).alias("locked"),
        *(c(n).alias(f"old_{n}") for n in PICKS.names if n not in keys),
    )
    new = incoming.withColumn("is_new", F.lit(True))
    joined = new.join(old, keys, "full_outer")
    merged = []
    for name in PICKS.names:
        if name in keys:
            merged.append(c(name))
        elif name in entry:
            keep = c("is_new").isNull() | c("locked")
            merged.append(F.when(keep, c(f"old_{name}")).otherwise(c(name)).alias(name))
        else:
            merged.append(F.when(c("is_new"), c(name)).otherwise(c(f"old_{name}")).alias(name))
    return joined.select(*merged)


@dataclass
class Manifest:
    """The state after a run: for each table and day the runs whose folders hold it.

    Its size grows with days, not with rows. ``applied`` holds the last batch of each stream.
    """

    number: int = 0
    tables: dict[str, dict[str, list[str]]] = field(default_factory=lambda: {n: {} for n in TABLES})
    applied: dict[str, int] = field(default_factory=dict)

    def as_text(self) -> str:
        return json.dumps({"schema_version": K.LEDGER_SCHEMA_VERSION, **self.__dict__}, sort_keys=True)

    @classmethod
    def of(cls, text: str) -> Manifest:
        held = json.loads(text)
        version = held.pop("schema_version", None)
        if version != K.LEDGER_SCHEMA_VERSION:
            raise ValueError(f"unsupported performance ledger schema: {version}")
        return cls(**held)

    def next(self) -> Manifest:
        tables = {n: {d: list(runs) for d, runs in days.items()} for n, days in self.tables.items()}
        return Manifest(self.number + 1, tables, dict(self.applied))

    def days(self, table: str) -> list[dt.date]:
        return [dt.date.fromisoformat(d) for d in sorted(self.tables[table])]


class ConcurrentRun(RuntimeError):
    """Another run published first; nothing of this one is visible. Run it again."""


class Ledger:
    """A ledger folder. All methods run Spark jobs; the driver holds days and folder names, no rows.

    ``version`` pins all reads to one manifest; a pinned ledger cannot be written.
    """

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        from norrsken.sources.store import Store

        self.spark = spark
        self.path = path.rstrip("/")
        self.version = version
        self._store = Store(spark, self.path)

    # Reading -------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._store.names("manifests") if n.endswith(".json")]

    def manifest(self) -> Manifest:
        number = self.version if self.version is not None else max(self.versions(), default=None)
        if number is None:
            return Manifest()
        return Manifest.of(self._store.read(f"manifests/{number:012d}.json"))

    def _read(self, manifest: Manifest, name: str, days: Iterable[dt.date] | None = None) -> DataFrame:
        """A table as of a manifest, whole or some days of it. Other days' folders are not even listed."""
        schema, partition = TABLES[name]
        held = manifest.tables[name]
        wanted = held if days is None else [d for d in {str(day) for day in days} if d in held]
        base = f"{self.path}/data/{name}"
        folders = [f"{base}/run={run}/{partition}={day}" for day in sorted(wanted) for run in held[day]]
        if not folders:
            # The limit lets the planner know that there are no rows, and leave out joins with them.
            return self.spark.createDataFrame([], schema).limit(0)
        stored = StructType([f for f in schema.fields if f.name != partition] + [
            StructField("run", StringType()), schema[partition]])
        return self.spark.read.schema(stored).option("basePath", base).parquet(*folders).select(*schema.names)

    def table(self, name: str) -> DataFrame:
        """picks, outcomes (open and settled), snapshots or tallies; empty when not written yet."""
        manifest = self.manifest()
        if not manifest.number:
            manifest = None
        if name == "outcomes":
            parts = [self._read(manifest, n) if manifest else None for n in ("settled", "open")]
            return parts[0].unionByName(parts[1]) if manifest else self._earlier("outcomes")
        return self._read(manifest, name) if manifest else self._earlier(name)

    def _earlier(self, name: str) -> DataFrame:
        """A table of a ledger without manifests, as the first layout wrote it: one folder for each day.

        Rows of other schema versions are refused.
        """
        schema, _ = TABLES[{"outcomes": "settled"}.get(name, name)]
        stored = StructType([*schema.fields, StructField("schema_version", IntegerType())])
        try:
            df = self.spark.read.schema(stored).parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)
        version = F.coalesce(F.col("schema_version").cast("string"), F.lit("none"))
        supported = version == str(K.LEDGER_SCHEMA_VERSION)
        message = F.concat(F.lit("unsupported performance ledger schema: "), version)
        return df.where(F.assert_true(supported, message).isNull()).select(*schema.names)

    def outcomes_with_picks(self) -> DataFrame:
        """Outcomes with the pick columns that the reports need."""
        picks = self.table("picks").select(
            "report_date", "pick_id", "strategy", "name", "ticker", "report_url"
        )
        return self.table("outcomes").join(sorted_side(picks), ["report_date", "pick_id"])

    # Writing -------------------------------------------------------------------------------------

    def _write(self, draft: Manifest, run: str, name: str, rows: DataFrame, replacing: Iterable[dt.date] | None) -> None:
        """Write rows under this run, and name their days in the draft.

        The days ``replacing`` lose what they held, also where ``rows`` has none; without it rows are added.
        The rebalance hint lets the adaptive planner split a large day over several tasks and write a small
        one as one file.
        """
        schema, partition = TABLES[name]
        conform(rows, schema).where(F.col(partition).isNotNull()).hint("rebalance", partition).write.partitionBy(
            partition).parquet(f"{self.path}/data/{name}/run={run}")
        held = draft.tables[name]
        for day in replacing or ():
            held.pop(str(day), None)
        for folder in self._store.names(f"data/{name}/run={run}"):
            if folder.startswith(f"{partition}="):
                held.setdefault(folder.partition("=")[2], []).append(run)

    def _publish(self, draft: Manifest) -> None:
        if not self._store.publish(f"manifests/{draft.number:012d}.json", draft.as_text()):
            raise ConcurrentRun(f"version {draft.number} of {self.path} is taken")

    def _begin(self) -> tuple[Manifest, str]:
        """The draft of the next manifest and this run's folder name. A first layout's rows are taken over."""
        if self.version is not None:
            raise ValueError("a ledger pinned to a version is read only")
        draft, run = self.manifest().next(), uuid.uuid4().hex
        if draft.number == 1:
            outcomes = self._earlier("outcomes")
            old = {"picks": self._earlier("picks"), "snapshots": self._earlier("snapshots"),
                   "open": outcomes.where(F.col("status") == K.NOT_DUE),
                   "settled": outcomes.where(F.col("status") != K.NOT_DUE)}
            if self._store.names("picks") or self._store.names("snapshots"):
                for name, rows in old.items():
                    self._write(draft, f"{run}-first", name, rows, None)
                self._write(draft, f"{run}-first", "tallies", return_tallies(old["settled"].join(sorted_side(
                    old["picks"].select("report_date", "pick_id", "strategy")), ["report_date", "pick_id"])), None)
        return draft, run

    def _add_picks(self, draft: Manifest, run: str, incoming: DataFrame) -> None:
        """Upsert picks by id, and open four outcomes for those that have none yet.

        A pick's outcomes lie on its due days, so whether it was priced shows on those days alone.
        """
        incoming = checkpointed(conform(incoming, PICKS).where(F.col("report_date").isNotNull()))
        days = [row[0] for row in incoming.select("report_date").distinct().collect()]
        if not days:
            return
        due_days = {weekday_after(day, n) for day in days for n in K.HORIZONS.values()}
        settled = self._read(draft, "settled", due_days)
        known = settled.unionByName(self._read(draft, "open", due_days)).select("pick_id", "horizon")
        fresh = open_outcomes(incoming).join(sorted_side(known), ["pick_id", "horizon"], "left_anti")
        priced = settled.where(F.col("status") == K.PRICED)
        existing = self._read(draft, "picks", days)
        self._write(draft, run, "open", fresh, None)
        self._write(draft, run, "picks", merge_picks(existing, incoming, priced), days)

    def _snapshot(self, draft: Manifest, run: str, quotes: DataFrame, days: list[dt.date]) -> None:
        rows = market_snapshot(quotes.withColumnRenamed("quote_date", "snapshot_date"))
        self._write(draft, run, "snapshots", rows, days)

    def _settle(self, draft: Manifest, run: str, quotes: DataFrame, days: list[dt.date]) -> None:
        """Settle what is due by the last of the run days; the first run on or after a due day decides.

        Days without an open row are neither listed nor read.
        """
        deciding = {d: min(r for r in days if r >= d) for d in draft.days("open") if d <= max(days)}
        if not deciding:
            return
        runs = self.spark.createDataFrame(list(deciding.items()), "due_date date, as_of_date date")
        reported = [d for d in draft.days("picks") if any(weekday_after(d, n) in deciding for n in K.HORIZONS.values())]
        entry = self._read(draft, "picks", reported).select(
            "pick_id", "report_date", "strategy", "ticker", "country", "entry_price", "entry_currency")
        moving = checkpointed(  # read twice: for the rows, and for the spans of their benchmark
            self._read(draft, "open", deciding).select("pick_id", "report_date", "horizon", "due_date")
            .join(F.broadcast(runs), "due_date").join(sorted_side(entry), ["pick_id", "report_date"])
        )
        snapshots = self._read(draft, "snapshots", {*reported, *days})
        settled = checkpointed(settle(moving, quotes, snapshots).select("strategy", *OUTCOMES.names))
        self._write(draft, run, "settled", settled, None)
        self._write(draft, run, "tallies", return_tallies(settled), None)
        for day in deciding:
            del draft.tables["open"][str(day)]

    def update_days(
        self, picks: DataFrame | None, quotes: DataFrame | None, days: Iterable[dt.date] = (),
        applied: tuple[str, int] | None = None,
    ) -> bool:
        """One run over one or several run days: picks, then snapshots, then outcomes (which need them).

        ``quotes`` has ``quote_date``; rows of other days than ``days`` are ignored. A run day without quotes is a
        run that found none. ``applied`` names a stream's batch: one that is not newer than what the manifest
        holds was seen before, and changes nothing (False).
        """
        draft, run = self._begin()
        if applied and draft.applied.get(applied[0], -1) >= applied[1]:
            return False
        if picks is not None:
            self._add_picks(draft, run, picks)
        days = sorted(set(days))
        if quotes is not None and days:
            quotes = checkpointed(quotes.where(F.col("quote_date").isin(days)))
            self._snapshot(draft, run, quotes, days)
            self._settle(draft, run, quotes, days)
        if applied:
            draft.applied[applied[0]] = applied[1]
        self._publish(draft)
        return True

    def update(self, reports_picks: DataFrame, quotes: DataFrame | None, as_of: dt.date) -> None:
        """The daily run. Without a price source (None) nothing is settled and due rows stay open."""
        dated = None if quotes is None else quotes.withColumn("quote_date", F.lit(as_of).cast("date"))
        self.update_days(reports_picks, dated, [as_of])

    def add_picks(self, incoming: DataFrame) -> None:
        self.update_days(incoming, None)

    def record_snapshot(self, quotes: DataFrame, day: dt.date) -> None:
        """Replace the snapshot of a day, also by one without rows."""
        draft, run = self._begin()
        self._snapshot(draft, run, quotes.withColumn("quote_date", F.lit(day).cast("date")), [day])
        self._publish(draft)

    def reject(self, rows: DataFrame, batch: int) -> None:
        """Keep what a batch of the stream could not use. A replayed batch replaces its own rows."""
        rows.write.mode("overwrite").parquet(f"{self.path}/rejected/batch={batch}")

    def forget(self, keep: int = 2) -> None:
        """Delete manifests but the newest ``keep``, and files that none of those names.

        Not while another run is on its way: its files have no manifest yet.
        """
        numbers = self.versions()
        for number in numbers[:-keep]:
            self._store.remove(f"manifests/{number:012d}.json")
        kept = [Manifest.of(self._store.read(f"manifests/{n:012d}.json")) for n in numbers[-keep:]]
        for name in TABLES:
            live = {f"run={run}" for m in kept for runs in m.tables[name].values() for run in runs}
            for folder in self._store.names(f"data/{name}"):
                if folder not in live:
                    self._store.remove(f"data/{name}/{folder}")


def read_ledger(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables as of one version."""
    ledger = Ledger(spark, path)
    pinned = Ledger(spark, path, version if version is not None else max(ledger.versions(), default=None))
    return {name: pinned.table(name) for name in ("picks", "outcomes", "snapshots", "tallies")}
