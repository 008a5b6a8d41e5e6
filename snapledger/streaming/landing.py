"""Incremental landing of newly arrived and rewritten snapshot files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapledger.operators.snapshots import of_partitions
from snapledger.session import settle
from snapledger.sources.catalog import configured, finished, source
from snapledger.sources.landing import PARTITION_COLUMNS, write_partitions, write_raw

# Files per micro-batch: a long backlog is worked off in bounded steps.
FILES_PER_BATCH = 10_000
# The record of landed files, beside the stream's own marks in its checkpoint folder.
LANDED = "filename string, modified timestamp, season int, load_date date"


def stream_source(
    spark: SparkSession,
    root: str,
    name: str,
    feeds: dict[str, str] | None = None,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """Streaming counterpart of `read_source`: the same columns, fed by files as they arrive."""
    entry = source(name)
    reader = configured(spark.readStream, name).option("basePath", entry.base(root, feeds))
    reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return finished(reader.load(entry.glob(root, feeds)), name)


def land_new_files(
    stream: DataFrame,
    read: Callable[[SparkSession], DataFrame],
    files: Callable[[SparkSession], DataFrame],
    path: str,
    checkpoint: str,
) -> None:
    """Land every partition that new or rewritten files have reached, then stop.

    `read` gives the same source as a batch, and `files` its listing (`filename`, `modified` and the partition columns), which opens
    no file. A partition is always replaced whole, so a repeated micro-batch gives the same table, a day landed again under new names
    supersedes the old one, and `write_raw` may write to the table too. The stream knows a file by its path alone; files
    rewritten in place are found afterwards by the modification times recorded at their last landing. Only the files of
    the reached partitions are read; their number is bounded by the calendar.
    """
    record = f"{checkpoint}/landed_files"

    def replace(spark: SparkSession, touched: DataFrame) -> None:
        reached = touched.select(*PARTITION_COLUMNS).distinct().collect()
        # recorded versions are listed before the rows are read: a file written in between is landed again next time
        versions = settle(files(spark).filter(of_partitions(reached)), "versions")
        write_raw(read(spark).filter(of_partitions(reached)), path)
        write_partitions(versions, record)

    query = (
        stream.writeStream.foreachBatch(lambda batch, _: replace(batch.sparkSession, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()

    spark = stream.sparkSession
    spark.createDataFrame([], LANDED).write.mode("ignore").partitionBy(*PARTITION_COLUMNS).parquet(record)
    known = spark.read.schema(LANDED).parquet(record)
    rewritten = files(spark).select(known.columns).join(known, known.columns, "left_anti")
    rewritten = settle(rewritten, "rewritten")
    if not rewritten.isEmpty():
        replace(spark, rewritten)
