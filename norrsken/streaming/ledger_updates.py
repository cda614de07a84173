"""Ledger updates from streams of landed report files and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, StringType, StructField, StructType

from norrsken.session import checkpointed
from norrsken.sources.ledger import Ledger
from norrsken.sources.reports import rejected_reports, report_picks, report_rows

REPORT_FILES = StructType([StructField("value", StringType()), StructField("report_date", DateType())])


def report_stream(spark: SparkSession, path: str) -> DataFrame:
    """Report files below ``report_date=`` folders as a stream, read like ``read_reports``."""
    files = spark.readStream.schema(REPORT_FILES).text(path, wholetext=True)
    return report_rows(files.withColumn("load_order", F.col("_metadata.file_path")))


def stream_ledger_update(
    reports: DataFrame, ledger: Ledger, checkpoint: str, available_now: bool = True,
    quotes: DataFrame | None = None,
) -> StreamingQuery:
    """Upsert the picks of every micro-batch and, with ``quotes`` (a stream with ``quote_date``), settle outcomes.

    The days that a batch has quotes of are its run days, worked off in one run of the ledger: the first of them
    on or after a due day decides an outcome, as if the days had been run one after the other. Quotes of a day
    must arrive in one batch, no earlier than the reports of the days before.

    The ledger's manifest holds the batch's number (under the checkpoint's path) together with its rows, so a batch
    that is replayed after a failure either finds nothing of itself, or is skipped. Broken files and reports of
    unknown strategies make no picks; they are kept in the ledger's ``rejected`` folder, a file set for each batch.
    """
    both = reports.select(F.struct("*").alias("report"))
    if quotes is not None:
        both = both.unionByName(quotes.select(F.struct("*").alias("quote")), allowMissingColumns=True)

    def upsert(batch: DataFrame, number: int) -> None:
        # With quotes the files of a batch are read once for picks, rejects and quotes.
        landed = checkpointed(batch) if quotes is not None else batch
        found = landed.where("report is not null").select("report.*")
        ledger.reject(rejected_reports(found), number)
        picks = report_picks(found, F.col("report_date"))
        if quotes is None:
            ledger.update_days(picks, None, applied=(checkpoint, number))
            return
        quoted = landed.where("quote is not null").select("quote.*")
        days = [row[0] for row in quoted.select("quote_date").distinct().collect()]
        ledger.update_days(picks, quoted, days, applied=(checkpoint, number))

    writer = both.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
