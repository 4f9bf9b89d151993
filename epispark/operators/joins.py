"""Join operators. No broadcast is forced: Spark broadcasts a side when its measured size allows
and otherwise shuffles, splitting skewed partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.scale import fill, interval_join, order_buckets

LEVELS = ("level_1", "level_2", "level_3")


def resolve_instruction(
    df: DataFrame, clean: DataFrame, key: str, raw: str, name: str
) -> DataFrame:
    """Cleaned instruction of the key, the raw one when it is missing or empty."""
    side = clean.select(key, F.col("text").alias("__text"))
    out = F.coalesce(F.nullif(F.col("__text"), F.lit("")), F.col(raw))
    return df.join(side, key, "left").withColumn(name, out).drop("__text")


def attach_task(
    df: DataFrame, tasks: DataFrame, index: str = "task_index", how: str = "inner"
) -> DataFrame:
    """Task text of a frame's task index."""
    return df.join(tasks.select(F.col("task_index").alias(index), "task"), index, how)


def promote_segments(
    frames: DataFrame, heads: DataFrame, key: str, index: str, task: str, segments: str
) -> DataFrame:
    """Per-frame level texts from ``[start, end)`` segments.

    Later segments override earlier ones, a null level leaves the value before it, level_1 starts
    from the task text. Segments meet frames through a bucketed equi-join, see
    :func:`epispark.scale.interval_join`.
    """
    spans = heads.select(key, F.posexplode(segments).alias("seg", "s")).select(
        key,
        "seg",
        F.greatest(F.coalesce("s.start", F.lit(0)), F.lit(0)).cast("long").alias("start"),
        F.coalesce(F.col("s.end").cast("long"), F.lit(2**31 - 1)).alias("end"),
        *[F.col(f"s.{lv}").alias(lv) for lv in LEVELS],
    )
    # a segment without an end reaches the end of the episode
    last = frames.groupBy(key).agg((F.max(index) + 1).alias("__t"))
    spans = spans.join(last, key).withColumn("end", F.least("end", "__t")).drop("__t")
    covered = interval_join(frames.select(key, index), spans, [key], index, "start", "end")
    chosen = covered.groupBy(key, index).agg(
        *[
            F.max(F.when(F.col(lv).isNotNull(), F.struct("seg", lv)))[lv].alias(lv)
            for lv in LEVELS
        ]
    )
    base = frames.drop(*LEVELS).join(heads.select(key, F.col(task).alias("__task")), key, "left")
    out = base.join(chosen, [key, index], "left")
    defaults = {"level_1": F.col("__task"), "level_2": F.lit(""), "level_3": F.lit("")}
    return out.withColumns(
        {lv: F.coalesce(F.col(lv), d, F.lit("")) for lv, d in defaults.items()}
    ).drop("__task")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    order: str,
    values: Sequence[str],
    name: str = "match",
) -> DataFrame:
    """Latest right row at or before each left row, as a struct column ``name`` (null if none).

    Both sides are stacked and filled forward in two levels over time buckets; at equal times right
    rows come first, and among them the one with the highest ``order`` is last.
    """
    both = _stack(left, right, keys, at, order, values)
    sort = [F.col(at), F.col("__side"), F.col("__o")]
    bucket = order_buckets(both, F.col(at))
    out = fill(both, keys, sort, bucket, F.col("__v"), name)
    return out.where("__side = 1").select(*left.columns, name)


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    order: str,
    values: Sequence[str],
    name: str = "match",
) -> DataFrame:
    """Right row with the smallest time distance; ties go to the earlier row, then lower order."""
    # per right time keep the lowest order, so that equal distances resolve to the earliest row
    first = right.groupBy(*keys, at).agg(
        F.min_by(F.struct(order, *values), F.col(order)).alias("r")
    )
    first = first.select(*keys, at, "r.*")
    both = _stack(left, first, keys, at, order, values)
    sort = [F.col(at), F.col("__side"), F.col("__o")]
    bucket = order_buckets(both, F.col(at))
    before = fill(both, keys, sort, bucket, F.col("__v"), "__before")
    back_sort = [F.col(at), -F.col("__side"), F.col("__o")]
    filled = fill(before, keys, back_sort, bucket, F.col("__v"), "__after", backward=True)
    gap_b = F.col(at) - F.col("__before")[at]
    gap_a = F.col("__after")[at] - F.col(at)
    best = F.when(
        F.col("__before").isNotNull() & (F.col("__after").isNull() | (gap_b <= gap_a)),
        F.col("__before"),
    ).otherwise(F.col("__after"))
    return filled.where("__side = 1").withColumn(name, best).select(*left.columns, name)


def _stack(left, right, keys, at, order, values) -> DataFrame:
    v = F.struct(F.col(at), F.col(order), *[F.col(c) for c in values])
    marks = right.select(
        *keys, at, F.lit(0).alias("__side"), F.col(order).cast("long").alias("__o"), v.alias("__v")
    )
    rows = left.select("*", F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__o"))
    return rows.unionByName(marks, allowMissingColumns=True)


def feature_window(
    samples: DataFrame,
    features: DataFrame,
    keys: Sequence[str],
    t: str,
    feat_idx: str,
    stride: int,
    history: int,
    future: int,
    value: str,
) -> DataFrame:
    """Feature rows around each sample: native frames ``t - (history-1)*stride`` on in steps of
    ``stride``, divided by the stride and clamped into the episode's features."""
    length = features.groupBy(*keys).agg((F.max(feat_idx) + 1).alias("__n"))
    pos = F.explode(
        F.sequence(F.lit(0), F.lit(history + future - 1))
    )
    rows = samples.select("*", pos.alias("pos"))
    native = F.col(t) + (F.col("pos") - (history - 1)) * stride
    want = rows.join(length, list(keys)).withColumn(
        feat_idx,
        F.greatest(F.lit(0), F.least(F.floor(native / stride), F.col("__n") - 1)).cast("long"),
    )
    return want.drop("__n").join(features.select(*keys, feat_idx, value), [*keys, feat_idx])


def not_done(df: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key has no finished ledger entry."""
    done = ledger.where(F.col("status") == "done").select(*keys)
    return df.join(done, list(keys), "left_anti")


def changed(df: DataFrame, state: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """Rows whose key is unknown or whose content hash differs from the published one."""
    return df.join(state.select(*keys, digest), [*keys, digest], "left_anti")


def ready_work(ledger: DataFrame, group: Sequence[str], stage: str, status: str) -> DataFrame:
    """Pending or requeued items all of whose earlier stages are done.

    Stages are numbered 0, 1, 2, ...; each group is reduced to one bit set of its finished stages,
    so no self-join is needed.
    """
    bit = F.expr(f"shiftleft(1L, cast({stage} as int))")
    finished = ledger.groupBy(*group).agg(
        F.coalesce(F.bit_or(F.when(F.col(status) == "done", bit)), F.lit(0)).alias("__done")
    )
    need = bit - 1
    return (
        ledger.where(F.col(status).isin("pending", "requeued"))
        .join(finished, list(group))
        .where(F.col("__done").bitwiseAND(need) == need)
        .drop("__done")
    )


def missing_artefacts(
    episodes: DataFrame, files: DataFrame, key: str, name: str, required: Sequence[str]
) -> DataFrame:
    """Required artefacts that an episode lacks."""
    want = episodes.select(
        key, F.explode(F.array(*[F.lit(r) for r in required])).alias(name)
    )
    return want.join(files.select(key, name).distinct(), [key, name], "left_anti")


def completeness(
    episodes: DataFrame,
    files: DataFrame,
    key: str,
    name: str,
    chunk: str,
    required: Sequence[str],
    camera_prefix: str = "camera_",
) -> DataFrame:
    """Per chunk: episodes, missing required files, episodes without any camera file, verdict."""
    found = files.groupBy(key).agg(
        F.collect_set(F.when(F.col(name).isin(*required), F.col(name))).alias("have"),
        F.bool_or(F.col(name).startswith(camera_prefix)).alias("camera"),
    )
    have = F.coalesce(F.size("have"), F.lit(0))
    rows = episodes.join(found, key, "left")
    out = rows.groupBy(chunk).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.sum(F.lit(len(required)) - have).cast("long").alias("n_missing"),
        F.count_if(~F.coalesce("camera", F.lit(False))).alias("n_no_camera"),
    )
    return out.withColumn("ok", (F.col("n_missing") == 0) & (F.col("n_no_camera") == 0))


def attach_rule(df: DataFrame, rules: DataFrame, key: str = "embodiment") -> DataFrame:
    """Rule columns of each row's embodiment; a missing rule is an error when the row is used."""
    known = rules.withColumn("__known", F.lit(True))
    checked = F.when(F.col("__known"), F.col(key)).otherwise(
        F.raise_error(F.concat(F.lit("no rule for embodiment "), F.col(key)))
    )
    return df.join(known, key, "left").withColumn(key, checked).drop("__known")


def split_by_rule(df: DataFrame, rules: DataFrame, key: str, width: Column):
    """Rows with a usable rule, and quarantined rows with the reason."""
    known = rules.withColumn("__known", F.lit(True))
    reason = F.when(F.col("__known").isNull(), "unknown embodiment").when(
        width < F.col("native_dim"), "too few dims"
    )
    rows = df.join(known, key, "left").withColumn("reason", reason).drop("__known")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null")


def bridge(tasks: DataFrame, datasets: DataFrame, on: str) -> DataFrame:
    """Datasets that support each task (many to many)."""
    return tasks.join(datasets, on).distinct()


def concat_camera_tokens(
    features: DataFrame, cameras: DataFrame, keys: Sequence[str], camera: str, tokens: str
) -> DataFrame:
    """Tokens of all cameras at the same episode and index, in camera order; absent ones skipped.

    At most one row per camera meets in a group.
    """
    rows = features.join(cameras.select(camera, "cam_order"), camera)
    item = F.struct("cam_order", F.col(tokens).alias("t"))
    return rows.groupBy(*keys).agg(
        F.flatten(F.array_sort(F.collect_list(item))["t"]).alias(tokens)
    )


def unique_position(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Position of each key; a key that occurs more than once is an error."""
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(position).alias(position))
    checked = F.when(F.col("__n") == 1, F.col(position)).otherwise(
        F.raise_error(F.lit("trajectory id is not unique"))
    )
    return out.withColumn(position, checked).drop("__n")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def rename_cameras(df: DataFrame, aliases: DataFrame, camera: str) -> DataFrame:
    """Canonical camera names; unmapped cameras are dropped."""
    names = aliases.select(F.col("alias").alias(camera), "canonical")
    return df.join(names, camera).drop(camera).withColumnRenamed("canonical", camera)
