"""Sinks: idempotent writes with a ledger, reports, statistics and publish state.

The order is always data first, ledger row second: a job that dies in between repeats the chunk,
and because a chunk is written by dynamic partition overwrite the repeat replaces it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark import schemas
from epispark.operators.joins import changed
from epispark.operators.quality import episode_rollup
from epispark.scale import BLOCK
from epispark.session import materialise
from epispark.sources.readers import few_listing_tasks

MAX_ROWS_PER_FILE = 2_000_000


def read_ledger(spark: SparkSession, path: str, schema: str = schemas.LEDGER) -> DataFrame:
    """Ledger rows; a ledger that does not exist yet is empty."""
    empty = spark.createDataFrame([], schema)
    found = stored(spark, path, empty)
    return empty if found is None else found


def ledger_rows(items: DataFrame, stage: str, status: str, source: Column, chunk: Column,
                item: Column, attempts: Column | None = None) -> DataFrame:
    if status not in schemas.STATUSES:
        raise ValueError(f"unknown status: {status}")
    return items.select(
        source.alias("source"),
        F.lit(stage).alias("stage"),
        chunk.cast("long").alias("chunk"),
        item.cast("string").alias("item"),
        F.lit(status).alias("status"),
        (F.lit(1) if attempts is None else attempts).cast("int").alias("attempts"),
        F.lit(0).alias("last_exit"),
        F.unix_micros(F.current_timestamp()).cast("double").alias("updated_at"),
    ).withColumn("updated_at", F.col("updated_at") / 1e6)


def latest_status(ledger: DataFrame) -> DataFrame:
    """Current state of each item of an append-only ledger; of equal times the later status wins."""
    rank = F.array_position(F.array(*[F.lit(s) for s in schemas.STATUSES]), F.col("status"))
    return ledger.groupBy("source", "stage", "chunk", "item").agg(
        F.max_by("status", F.struct("updated_at", rank)).alias("status"),
        F.sum("attempts").alias("attempts"),
        F.max("updated_at").alias("updated_at"),
    )


def finished(ledger: DataFrame) -> DataFrame:
    """Items whose :func:`latest_status` is ``done``, from numbers only: sums in a hash map, no sort of the ledger."""
    names = F.array(*[F.lit(s) for s in schemas.STATUSES])
    done, later = F.col("status") == "done", F.array_position(names, F.col("status")) > F.array_position(names, F.lit("done"))
    at = F.coalesce("updated_at", F.lit(float("-inf")))
    times = ledger.groupBy("source", "stage", "chunk", "item").agg(
        F.max(F.when(done, at)).alias("__done"), F.max(F.when(later, at)).alias("__later"), F.max(at).alias("__last"))
    latest = (F.col("__done") >= F.col("__last")) & (F.col("__later").isNull() | (F.col("__later") < F.col("__done")))
    return times.where(latest).select("source", "stage", "chunk", "item")


def write_frames(
    frames: DataFrame, path: str, ledger_path: str, stage: str = "convert",
    source: str = "source", chunk: str = "chunk", episode: str = "episode_index",
    index: str = "frame_index", episodes: DataFrame | None = None,
) -> None:
    """Write the unfinished episodes, then mark those that have been written.

    A chunk is replaced as a whole by its stored rows and the new episodes, so increments keep what
    is there and a rerun after a crash cannot duplicate rows: rows of unmarked episodes are not
    carried over. Chunks whose episodes are all marked are not touched, and an episode without
    frames stays unmarked. Only a crash leaves unmarked episodes, so stored episodes are compared with the
    ledger first, and stored rows meet a join only if there are any. Stored rows go straight into the new
    files: a dynamic overwrite drops the old ones once all tasks are done. Rows are distributed by chunk and
    frame block, so a task gets a bounded share even of a very long episode, and sorted for episode filters.
    ``episodes`` is the manifest (source, chunk, episode) if there is one.
    """
    spark = frames.sparkSession
    few_listing_tasks(spark)
    done = finished(read_ledger(spark, ledger_path).where(F.col("stage") == stage))
    # a row per episode: its files are far smaller than its rows in memory, so it is never broadcast
    done = done.select(F.col("source").alias(source), F.col("item").cast("long").alias(episode)).hint("merge")
    wanted = frames
    if episodes is not None:
        wanted = frames.join(episodes.select(source, episode).hint("merge"), [source, episode], "left_semi")
    todo = materialise(wanted.join(done, [source, episode], "left_anti").select(frames.columns), "pending")
    written = materialise(todo.select(source, chunk, episode).distinct(), "pending-keys")
    touched = written.select(source, chunk).distinct()
    if touched.isEmpty():
        return
    present = stored(spark, path, todo)
    if present is not None:
        kept = present.join(touched, [source, chunk], "left_semi").select(todo.columns)
        kept = kept.where(F.col(source).isNotNull() & F.col(episode).isNotNull())
        keys = kept.select(source, episode).distinct()
        strays = materialise(keys.join(done, [source, episode], "left_anti"), "strays")
        if not strays.isEmpty():
            kept = kept.join(strays.hint("merge"), [source, episode], "left_anti")
        todo = kept.unionByName(todo)
    block = F.floor(F.col(index) / BLOCK)
    clustered = todo.repartition(F.col(source), F.col(chunk), block).sortWithinPartitions(
        source, chunk, episode, index
    )
    overwrite_chunks(clustered, path, source, chunk)
    rows = ledger_rows(written, stage, "done", F.col(source), F.col(chunk), F.col(episode))
    rows.write.mode("append").parquet(ledger_path)


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame | None:
    """The table at ``path`` with the columns of ``like``, None where there is none yet."""
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return None


def overwrite_chunks(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace exactly the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .partitionBy(*partitions)
        .parquet(path)
    )


def roll_up(
    frames: DataFrame, out: str, source: str, chunk_size: int, fps: float, fps_features: float,
    min_frames: int = 32,
) -> None:
    """Frames of long enough episodes, the episode table and a one-row info file.

    Rows are clustered by chunk and frame block before the write; a rerun replaces all three. Episodes are
    counted once, from the frames: the written folders, one per chunk, are neither listed nor read again.
    """
    spark = frames.sparkSession
    known = frames.where(F.col("episode_index").isNotNull())
    episodes = episode_rollup(known, "episode_index", "embodiment", chunk_size)
    episodes = materialise(episodes.where(F.col("length") >= min_frames), "episodes")
    # a row per episode: its files are far smaller than its rows in memory, so it is never broadcast
    kept = known.join(episodes.select("episode_index").hint("merge"), "episode_index", "left_semi")
    kept = kept.withColumn("chunk", F.floor(F.col("episode_index") / chunk_size))
    clustered = kept.repartition("chunk", F.floor(F.col("frame_index") / BLOCK))
    clustered.write.mode("overwrite").partitionBy("chunk").parquet(f"{out}/data")
    episodes.write.mode("overwrite").parquet(f"{out}/meta/episodes")
    table = spark.read.parquet(f"{out}/meta/episodes")
    info = table.agg(
        F.lit("v2.1").alias("codebase_version"),
        F.lit(source).alias("source"),
        F.lit(float(fps)).alias("fps"),
        F.lit(float(fps_features)).alias("fps_features"),
        F.count(F.lit(1)).alias("n_episodes"),
        F.sum("length").alias("n_frames"),
    )
    info.write.mode("overwrite").json(f"{out}/meta/info")


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Fixed columns and order; an empty manifest still writes its schema."""
    manifest.select(*schemas.MANIFEST_COLUMNS).write.parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def statistics_json(stats: DataFrame, tag: str, order: Sequence[str] = ("key", "dim")) -> DataFrame:
    """One JSON document per tag: key -> six vectors, plus the transition and trajectory counts.

    ``stats`` has (tag, key, dim, six values, num_transitions, num_trajectories); a document is as
    long as the tag's vectors.
    """
    names = ["mean", "std", "min", "max", "q01", "q99"]
    item = F.struct("dim", *names)
    keys = stats.groupBy(tag, "key", "num_transitions", "num_trajectories").agg(
        F.array_sort(F.collect_list(item)).alias("a")
    )
    entry = F.struct(*[F.col(f"a.{n}").alias(n) for n in names])
    docs = keys.groupBy(tag, "num_transitions", "num_trajectories").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", entry.alias("s"))))).alias("m")
    )
    body = F.struct("num_transitions", "num_trajectories", F.col("m").alias("statistics"))
    return docs.select(tag, F.to_json(body).alias("value"))


def write_statistics(stats: DataFrame, tag: str, path: str) -> None:
    statistics_json(stats, tag).write.partitionBy(tag).text(path)


def write_features(features: DataFrame, path: str) -> None:
    """Feature rows partitioned by camera, modality and real chunk; ragged tensors are an error."""
    ragged = F.exists("tokens", lambda t: F.size(t) != F.size(F.get("tokens", F.lit(0))))
    checked = F.when(~ragged, F.col("tokens")).otherwise(
        F.raise_error(F.lit("tokens must form a rank-3 tensor"))
    )
    (
        features.withColumn("tokens", checked)
        .repartition("camera", "modality", "chunk", "episode_index")
        .sortWithinPartitions("camera", "modality", "chunk", "episode_index", "feat_idx")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("camera", "modality", "chunk")
        .parquet(path)
    )


def cached_table(spark: SparkSession, root: str, config: dict, build: Callable[[], DataFrame]):
    """Table stored under the hash of its configuration; built and written only when absent.

    It is written to a fresh folder, and a row of ``root/published`` then makes it known; a folder
    that a dead job left behind is never read, and of two jobs at once the first name counts.
    """
    import hashlib
    import json
    import uuid

    key = hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()
    fields = T.StructType([T.StructField("key", T.StringType()), T.StructField("folder", T.StringType())])
    entry = spark.createDataFrame([(key, f"{key}-{uuid.uuid4().hex}")], fields)

    def folder() -> str | None:
        known = stored(spark, f"{root}/published", entry)
        return None if known is None else known.where(F.col("key") == key).agg(F.min("folder")).first()[0]

    if folder() is None:
        build().write.parquet(f"{root}/{entry.first()['folder']}")
        entry.write.mode("append").parquet(f"{root}/published")
    return spark.read.parquet(f"{root}/{folder()}")


def publish_changed(
    chunks: DataFrame, state_path: str, keys: Sequence[str], digest: str,
    upload: Callable[[DataFrame], None],
) -> None:
    """Hand the changed chunks to a callable sink, then append their hashes to the state table.

    The state is append-only and numbered by publication; a chunk's latest hash counts, so content
    that returns to an older form is published again. The changed chunks are written once: what is
    uploaded is what is recorded.
    """
    spark = chunks.sparkSession
    numbered = chunks.select(*keys, digest).withColumn("publication", F.lit(0).cast("long"))
    state = stored(spark, state_path, numbered)
    number = 0
    if state is None:
        todo = chunks
    else:
        number = state.agg(F.max("publication")).first()[0] + 1
        latest = state.groupBy(*keys).agg(F.max_by(digest, "publication").alias(digest))
        todo = changed(chunks, latest, keys, digest)
    todo = materialise(todo, "publish")
    if todo.isEmpty():
        return
    upload(todo)
    rows = todo.select(*keys, digest).withColumn("publication", F.lit(number).cast("long"))
    rows.write.mode("append").parquet(state_path)


def chunk_complete(
    frames: DataFrame, ledger_path: str, size: Column, started: float, stage: str = "chunk",
    source: str = "source", chunk: str = "chunk", episode: str = "episode_index",
) -> None:
    """Append one finished row per chunk with its episodes, frames, bytes and elapsed seconds."""
    stats = frames.groupBy(source, chunk).agg(
        F.count_distinct(F.col(episode)).alias("n_episodes"),
        F.count(F.lit(1)).alias("n_frames"),
        F.sum(size).alias("bytes"),
    )
    rows = ledger_rows(stats, stage, "done", F.col(source), F.col(chunk), F.lit("*"))
    facts = stats.select(
        F.col(source).alias("__s"), F.col(chunk).cast("long").alias("__c"), "n_episodes", "n_frames", "bytes"
    )
    same = F.col("source").eqNullSafe(F.col("__s")) & F.col("chunk").eqNullSafe(F.col("__c"))
    full = rows.join(facts, same).drop("__s", "__c")
    elapsed = F.col("updated_at") - F.lit(started)
    full.withColumn("elapsed_seconds", elapsed).write.mode("append").parquet(ledger_path)


def write_evaluation(steps: DataFrame, path: str, by: str = "traj_id") -> None:
    """Per-trajectory evaluation rows; clustered by trajectory, few files per task."""
    steps.repartition(by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)
