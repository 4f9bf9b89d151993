"""Filters, validation reports, orderings and set checks over episodic tables and listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.functions.ids import chunk_of
from epispark.functions.vectors import canonical_ok
from epispark.scale import global_rank

MAX_FILES_PER_CHUNK = 1000
MAX_BYTES_PER_FILE = 5 * 1024**3
MIN_EPISODE_FRAMES = 32
EPISODES_PER_CHUNK = 256
# fixed values: embodiment folders that hold simulated episodes
SIMULATED = ["h5_simulation"]


def drop_simulated(df: DataFrame, embodiment: str, names: Sequence[str] = SIMULATED) -> DataFrame:
    return df.where(~F.col(embodiment).isin(*names))


def long_enough(
    frames: DataFrame, key: str, min_frames: int = MIN_EPISODE_FRAMES
) -> DataFrame:
    """Frames of episodes with at least ``min_frames`` frames.

    The count is pre-aggregated; the kept keys meet the frames in a semi-join that Spark broadcasts
    or splits by size.
    """
    keep = frames.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_frames)
    return frames.join(keep.select(key), key, "left_semi")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The same rows; running the plan fails when there are none.

    The check rides along as one guard row that is evaluated and filtered out.
    """
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    verdict = F.when(n > 0, F.lit(False)).otherwise(
        F.raise_error(F.lit(f"no {what} left")).cast("boolean")
    )
    guard = df.sparkSession.range(1, numPartitions=1).where(verdict)
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema]
    return df.unionByName(guard.select(*nulls))


def with_language(first_frames: DataFrame, tasks: DataFrame, key: str) -> DataFrame:
    """Episodes whose task text at frame 0 exists and is not empty."""
    return first_frames.join(tasks, "task_index").where(F.col("task") != "").select(key)


def in_chunk(index: Column, chunk: int, size: int = EPISODES_PER_CHUNK, mode: str = "contiguous"):
    """Chunk membership: contiguous ranges of ``size`` or every ``size``-th episode."""
    if mode == "contiguous":
        return chunk_of(index, size) == chunk
    if mode == "stride":
        return index % size == chunk
    raise ValueError(f"unknown chunk mode: {mode}")


def payload_files(listing: DataFrame, rel: Column) -> DataFrame:
    """Files that are data: no dot-files, nothing below a ``done`` folder."""
    return listing.where(~rel.rlike(r"(^|/)\.[^/]*$") & ~rel.rlike(r"(^|/)done(/|$)"))


def action_report(df: DataFrame, keys: Sequence[str], action: str) -> DataFrame:
    """Rows checked and rows outside the canonical bounds per key."""
    ok = canonical_ok(F.col(action))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("n_bad"), F.bool_and(ok).alias("ok")
    )


def existing_only(samples: DataFrame, files: DataFrame, on: str) -> DataFrame:
    """Samples whose file exists."""
    return samples.join(files, on, "left_semi")


def without_quarantined(df: DataFrame, quarantine: DataFrame, on: str) -> DataFrame:
    return df.join(quarantine, on, "left_anti")


def missing_columns(required: Sequence[str], schema: T.StructType) -> list[str]:
    """Required columns that a table lacks; extra columns are fine."""
    return [c for c in required if c not in schema.names]


def table_report(
    df: DataFrame, required: Sequence[str], file: Column, kind: str = "table"
) -> DataFrame:
    """Validation rows ``path, kind, ok, errors, info``: required columns, at least one row."""
    lack = missing_columns(required, df.schema)
    errors = F.array(*[F.lit(f"missing column: {c}") for c in lack]).cast("array<string>")
    rows = df.groupBy(file.alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        "path",
        F.lit(kind).alias("kind"),
        F.lit(not lack).alias("ok"),
        errors.alias("errors"),
        F.create_map(F.lit("num_rows"), F.col("n").cast("string")).alias("info"),
    )


def missing_from_list(required: Column, present: Column) -> Column:
    return F.array_except(required, present)


def pass_fail(report: DataFrame, kind: str, ok: str) -> DataFrame:
    """Passed and failed shards per kind."""
    return report.groupBy(kind).agg(
        F.count_if(ok).alias("passed"), F.count_if(~F.col(ok)).alias("failed")
    )


def folder_report(
    listing: DataFrame,
    folder: str,
    path: str = "path",
    size: str = "length",
    max_files: int = MAX_FILES_PER_CHUNK,
    max_bytes: int = MAX_BYTES_PER_FILE,
) -> DataFrame:
    """Files, bytes, largest file, oversized files and the verdict per folder."""
    out = listing.groupBy(folder).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum(size).alias("total_bytes"),
        F.max(size).alias("largest_bytes"),
        F.min_by(path, F.struct(-F.col(size), F.col(path))).alias("largest_file"),
        F.count_if(F.col(size) > max_bytes).alias("n_oversized"),
    )
    return out.withColumn(
        "ok", (F.col("file_count") <= max_files) & (F.col("n_oversized") == 0)
    )


def id_set_hash(df: DataFrame, keys: Sequence[str], item: str, n: int = 12) -> DataFrame:
    """Order-insensitive hash of the ids of a shard. A shard is one chunk of bounded size."""
    text = F.array_join(F.array_sort(F.collect_list(item)), "\n")
    return df.groupBy(*keys).agg(F.substring(F.sha2(text.cast("binary"), 256), 1, n).alias("hash"))


def listing_hash(
    df: DataFrame, chunk: Sequence[str], path: str, size: str, mtime: str, n: int = 16
) -> DataFrame:
    """Hash of (path, size, mtime) of a chunk's files in path order. Chunks hold a bounded number
    of files, see :func:`plan_chunks`."""
    item = F.struct(
        F.col(path).alias("p"),
        F.concat_ws(
            "|", path, F.col(size).cast("string"), F.col(mtime).cast("long").cast("string")
        ).alias("t"),
    )
    text = F.array_join(F.array_sort(F.collect_list(item))["t"], "\n")
    return df.groupBy(*chunk).agg(F.substring(F.sha2(text.cast("binary"), 256), 1, n).alias("hash"))


def plan_chunks(
    listing: DataFrame, root: str, path: str, max_files: int = MAX_FILES_PER_CHUNK
) -> DataFrame:
    """Chunk number of each file: ``max_files`` consecutive files in path order per root."""
    ranked = global_rank(listing, [root, path], "__i")
    first = ranked.groupBy(root).agg(F.min("__i").alias("__first"))
    chunk = F.floor((F.col("__i") - F.col("__first")) / max_files)
    return ranked.join(first, root).withColumn("chunk_id", chunk).drop("__i", "__first")


def chunk_sizes(planned: DataFrame, root: str, size: str) -> DataFrame:
    return planned.groupBy(root, "chunk_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(size).alias("total_bytes")
    )


def space_by_category(listing: DataFrame, path: Column, size: str) -> DataFrame:
    """Bytes and files per disposable category of a chunk folder; everything else is kept."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    category = (
        F.when(path.rlike(r"/_scratch/"), "scratch")
        .when(path.rlike(r"/done/"), "done_markers")
        .when(name.rlike(r"^depth_.*\.npy$"), "depth_npy")
        .when(name.rlike(r"^depth_.*\.json$"), "depth_json")
        .otherwise("kept")
    )
    return listing.groupBy(category.alias("category")).agg(
        F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("files")
    )


def episode_rollup(frames: DataFrame, key: str, embodiment: str, chunk_size: int) -> DataFrame:
    """Length, chunk, file and embodiment per episode; the source index is kept as it is."""
    return frames.groupBy(key).agg(
        F.count(F.lit(1)).alias("length"), F.min(embodiment).alias("embodiment")
    ).withColumns({"chunk": F.floor(F.col(key) / chunk_size), "file": F.lit(0)})


# ---- orderings ----------------------------------------------------------------------------


def grippers_last(df: DataFrame, key: str, order: str) -> DataFrame:
    """Stable order with gripper keys behind all others."""
    return df.orderBy(F.lower(F.col(key)).contains("gripper"), order)


def limit_chunks(df: DataFrame, chunk: str, start: int, n: int) -> DataFrame:
    """The first ``n`` chunks from a start offset on."""
    return df.where(F.col(chunk) >= start).orderBy(chunk).limit(n)


def top_priority(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def even_picks(length: Column, interval: Column, low: int = 4, high: int = 8) -> Column:
    """Evenly spaced positions over ``[0, length)``: ``round(length / interval)`` of them, between
    ``low`` and ``high``, truncated to whole positions, without repeats."""
    n = F.least(F.greatest(F.bround(length / interval), F.lit(low)), F.lit(high)).cast("int")
    step = (length - 1) / (n - 1)
    return F.array_distinct(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * step))
    )


def rate_stride(src_fps: Column, dst_fps: Column) -> Column:
    """Every how many frames to keep to go from one rate to another (half to even, at least 1)."""
    return F.greatest(F.bround(src_fps / dst_fps).cast("long"), F.lit(1))


def subsample_rate(df: DataFrame, index: str, src_fps: Column, dst_fps: Column) -> DataFrame:
    return df.where(F.col(index) % rate_stride(src_fps, dst_fps) == 0)


def keep_tokens(tokens: Column, patches: int = 64) -> Column:
    """The class token and the first patch tokens."""
    return F.slice(tokens, 1, patches + 1)


# ---- set checks ---------------------------------------------------------------------------


def ordered_union(df: DataFrame, key: str, ordinal: Sequence[str]) -> DataFrame:
    """Distinct keys in the order of their first appearance."""
    first = F.min(F.struct(*ordinal)).alias("first_seen")
    return df.groupBy(key).agg(first).orderBy("first_seen")


def shard_audit(df: DataFrame, item: str, shard: str) -> DataFrame:
    """Items in more than one shard and items in none, as counts (both 0 for a partition)."""
    per = df.groupBy(item).agg(F.count_distinct(shard).alias("n"))
    return per.agg(
        F.count_if(F.col("n") > 1).alias("n_overlapping"),
        F.count_if(F.col("n") == 0).alias("n_unassigned"),
        F.count(F.lit(1)).alias("n_items"),
    )


def loss_and_duplicates(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """Keys lost, unexpected or produced more than once, with the reason."""
    n = F.count(F.lit(1))
    e = expected.groupBy(key).agg(n.alias("want"))
    p = produced.groupBy(key).agg(n.alias("got"))
    both = e.join(p, key, "full")
    want, got = (F.coalesce(c, F.lit(0)) for c in ("want", "got"))
    reason = (
        F.when(got < want, "lost").when(want == 0, "unexpected").when(got > want, "duplicate")
    )
    return both.select(key, reason.alias("reason")).where("reason is not null")


def same_members(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: whether two tables hold the same distinct keys."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    diff = left.exceptAll(right).unionByName(right.exceptAll(left))
    return diff.agg(
        (F.count(F.lit(1)) == 0).alias("same"), F.count(F.lit(1)).alias("n_different")
    )


# ---- batches ------------------------------------------------------------------------------


def assign_batches(df: DataFrame, index: str, size: int) -> DataFrame:
    return df.withColumn("batch", F.floor(F.col(index) / size))


def pad_batches(
    df: DataFrame, batch: str, tokens: str, pad: int, max_length: int | None = None
) -> DataFrame:
    """Token arrays, cut to ``max_length`` if given, padded to their batch's longest, with a mask.

    The longest length is one aggregated row per batch.
    """
    cut = df if max_length is None else df.withColumn(tokens, F.slice(tokens, 1, max_length))
    longest = cut.groupBy(batch).agg(F.max(F.size(tokens)).alias("__w"))
    n = F.size(tokens)
    fill = F.col("__w") - n
    return (
        cut.join(longest, batch)
        .withColumns(
            {
                "input_ids": F.concat(tokens, F.array_repeat(F.lit(pad), fill)),
                "attention_mask": F.concat(
                    F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), fill)
                ),
            }
        )
        .drop("__w", tokens)
    )


def pack_batches(
    df: DataFrame, batch: str, order: str, tokens: str, max_length: int | None = None
) -> DataFrame:
    """Token arrays of a batch laid end to end with the start offset of each (plus the total).

    A batch has a fixed number of rows, so the lists are bounded.
    """
    cut = df if max_length is None else df.withColumn(tokens, F.slice(tokens, 1, max_length))
    item = F.struct(F.col(order).alias("o"), F.col(tokens).alias("t"))
    lists = cut.groupBy(batch).agg(F.array_sort(F.collect_list(item))["t"].alias("parts"))
    sizes = F.transform("parts", F.size)
    offsets = F.transform(
        F.sequence(F.lit(0), F.size("parts")),
        lambda i: F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda s, x: s + x),
    )
    return lists.select(batch, F.flatten("parts").alias("input_ids"), offsets.alias("cu_seqlens"))


def collate_vectors(df: DataFrame, batch: str, order: str, vector: str) -> DataFrame:
    """Vectors of a batch in order, and whether they stack (all of one length)."""
    item = F.struct(F.col(order).alias("o"), F.col(vector).alias("v"))
    return df.groupBy(batch).agg(
        F.array_sort(F.collect_list(item))["v"].alias("rows"),
        (F.count_distinct(F.size(vector)) == 1).alias("stacked"),
    )


def stack_blocks(
    frames: DataFrame, keys: Sequence[str], index: str, columns: Sequence[str], size: int = 4096
) -> DataFrame:
    """Per-episode matrices in blocks of at most ``size`` rows, in frame order."""
    item = F.struct(index, *columns)
    out = frames.groupBy(*keys, F.floor(F.col(index) / size).alias("block")).agg(
        F.array_sort(F.collect_list(item)).alias("rows")
    )
    return out.select(*keys, "block", *[F.col(f"rows.{c}").alias(c) for c in columns])


def explode_arrays(
    episodes: DataFrame, keys: Sequence[str], index: str, columns: Sequence[str]
) -> DataFrame:
    """One row per frame from parallel per-episode arrays."""
    zipped = F.arrays_zip(*[F.col(c) for c in columns])
    out = episodes.select(*keys, F.posexplode(zipped).alias(index, "z"))
    return out.select(*keys, index, *[F.col(f"z.{c}").alias(c) for c in columns])


def cumulative_count(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Running count over an already aggregated table (few rows per key)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum("n").over(w))
