"""Structured Streaming jobs: idempotent ingest, folder watch, duplicate suppression, live metrics."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark import schemas
from epispark.sources.sinks import ledger_rows, read_ledger, stored


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*",
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream; a trigger takes a bounded number of files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process everything available, append it to a parquet table, return that table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def prefix(source: Column, item: Column, digits: int) -> Column:
    """Ledger partition of an item: the first digits of a hash of its source and name."""
    name = F.concat_ws("/", source, item.cast("string"))
    return F.concat(F.lit("p"), F.substring(F.md5(name), 1, digits)).alias("prefix")


def ingest(
    stream: DataFrame, convert: Callable[[DataFrame], DataFrame], out: str, ledger: str,
    checkpoint: str, source: str = "source", item: str = "episode_index", digits: int = 1,
) -> None:
    """Resumable ingest: each micro-batch replaces its own partition, then its episodes are marked.

    A micro-batch that is replayed after a crash has the same number and the same input, so neither
    loss nor duplicates occur. Items that the ledger names as done are not converted again, also
    after a restart with a fresh checkpoint folder, whose batches get names of their own. ``item`` is
    what is delivered as a whole, in one file, and marked: an episode by default.

    The ledger is partitioned by a hash prefix of source and item, then by batch, and a batch reads only
    the prefixes of its own items: a small batch does not scan what all others have marked. A batch's marks
    take up to 16 ** ``digits`` folders; keep the digits of a ledger, raise them for one with many items.
    """
    spark = stream.sparkSession
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def flush(batch: DataFrame, number: int) -> None:
        folder = f"{run}-{number}"
        prefixes = [r.prefix for r in batch.select(prefix(F.col(source), F.col(item), digits)).distinct().collect()]
        done = read_ledger(spark, ledger, f"{schemas.LEDGER}, prefix string, batch string").where(
            F.col("prefix").isin(prefixes) & (F.col("status") == "done") & (F.col("batch") != folder)
        ).select(F.col("source").alias("__s"), F.col("item").alias("__i"))
        fresh = batch.join(
            done, (F.col(source) == F.col("__s")) & (F.col(item).cast("string") == F.col("__i")), "left_anti"
        )
        frames = convert(fresh).withColumn("batch", F.lit(folder))
        (
            frames.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(out)
        )
        # the marks come from what was written, not from a second conversion
        written = stored(spark, f"{out}/batch={folder}", frames.drop("batch"))
        if written is None:  # nothing new in this batch
            return
        done = written.select(source, item).distinct()
        rows = ledger_rows(done, "ingest", "done", F.col(source), F.lit(number), F.col(item))
        (
            rows.withColumn("prefix", prefix(F.col("source"), F.col("item"), digits))
            .withColumn("batch", F.lit(folder))
            .repartition("prefix")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("prefix", "batch")
            .parquet(ledger)
        )

    query = (
        stream.writeStream.foreachBatch(flush)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def watch_folder(
    spark: SparkSession, path: str, checkpoint: str, publish: Callable[[DataFrame, int], None],
    pattern: str = "*", every: str | None = "10 minutes",
):
    """Hand new files of a folder (path, length, time; no contents) to a callable sink.

    ``every=None`` processes what is there and stops.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(*schemas.LISTING_COLUMNS)
    )
    writer = files.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()


def drop_repeats(
    stream: DataFrame, time: str, keys: Sequence[str], delay: str = "1 hour"
) -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def live_metrics(
    stream: DataFrame, time: str, episode: str, refreshed: Column, drift: Column,
    window: str = "1 hour", delay: str = "10 minutes",
) -> DataFrame:
    """Refreshes and mean drift per episode and event-time window."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, window).alias("w"), episode)
        .agg(
            F.count_if(refreshed).alias("refresh_count"),
            F.avg(drift).alias("mean_drift"),
            F.count(F.lit(1)).alias("n_steps"),
        )
        .select(F.col("w.start").alias("window_start"), episode, "refresh_count", "mean_drift",
                "n_steps")
    )
