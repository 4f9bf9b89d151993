"""Statistics of vector columns in long form ``(keys..., dim, value)``, their merge and layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.functions.ids import hash_uniform
from epispark.operators.windows import pose_deltas
from epispark.scale import exact_quantiles, explode_range, small_side

STATS = ("mean", "std", "min", "max", "q01", "q99")
# columns that are never summarised
SKIPPED_PREFIX = "annotation."


def explode_vector(df: DataFrame, vector: str, *keep: str) -> DataFrame:
    """Array column to (keep, dim, value) rows."""
    return df.select(*keep, F.posexplode(vector).alias("dim", "value"))


def drop_bad_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is present and free of null and NaN."""
    v = F.col(vector)
    return df.where(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))


def summarised_columns(
    columns: Sequence[str], pose_columns: Sequence[str] = (), extra: Sequence[str] = ("task_info",)
) -> list[str]:
    """Column names that enter the statistics: no annotations, pose or task bookkeeping columns."""
    skip = {*pose_columns, *extra}
    return [c for c in columns if not c.startswith(SKIPPED_PREFIX) and c not in skip]


def column_statistics(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean, population deviation, min, max and exact 1 % / 99 % quantiles per key group.

    Null and NaN values are skipped. Moments are partially aggregated before the shuffle; the
    quantiles never hold a group's values in one place.
    """
    moments = [
        F.avg("__v").alias("mean"),
        F.stddev_pop("__v").alias("std"),
        F.min("__v").alias("min"),
        F.max("__v").alias("max"),
    ]
    out = exact_quantiles(df, keys, F.col(value), [0.01, 0.99], extra=moments)
    return out.select(
        *keys,
        "n",
        "mean",
        "std",
        "min",
        "max",
        F.col("q")[0].alias("q01"),
        F.col("q")[1].alias("q99"),
    )


def stats_vector(stats: DataFrame, order: str, names: Sequence[str] = STATS) -> DataFrame:
    """One row ``stats array<struct<...>>`` ordered by dimension; as wide as the vector is long."""
    item = F.struct(F.col(order).alias("o"), F.struct(*names).alias("s"))
    return stats.agg(F.array_sort(F.collect_list(item)).alias("a")).select(
        F.col("a.s").alias("stats")
    )


def fit(stats: DataFrame, order: str = "dim", max_dims: int = 4096) -> Column:
    """Statistics bound into a transform as constants, like a fitted model.

    One row per vector dimension is read; more than ``max_dims`` rows are an error.
    """
    rows = stats.select(order, *STATS).orderBy(order).limit(max_dims + 1).collect()
    if len(rows) > max_dims:
        raise ValueError(f"more than {max_dims} dimensions")
    return F.array(*[F.struct(*[F.lit(r[n]).cast("double").alias(n) for n in STATS]) for r in rows])


def slice_statistics(stats: DataFrame, modality: DataFrame) -> DataFrame:
    """Statistics of the logical keys cut out of physical columns.

    ``stats`` has (column, dim, ...), ``modality`` has (key, column, start, end).
    """
    return (
        stats.join(modality, "column")
        .where((F.col("dim") >= F.col("start")) & (F.col("dim") < F.col("end")))
        .withColumn("dim", F.col("dim") - F.col("start"))
        .drop("start", "end")
    )


def merge_statistics(
    stats: DataFrame,
    weights: DataFrame,
    dataset: str,
    keys: Sequence[str],
    method: str = "weighted_average",
    group: Sequence[str] = (),
) -> DataFrame:
    """Statistics of a weighted mixture from per-dataset statistics.

    Weights are normalised over the datasets of the group that have the key; means and second
    moments are averaged, min/max are envelopes, quantiles averaged or (``min_max``) enveloped.
    """
    if method not in ("weighted_average", "min_max"):
        raise ValueError(f"unknown quantile method: {method}")
    by = [*group, *keys]
    w = F.col("weight")
    rows = stats.join(weights, dataset)

    def mean_of(x: Column) -> Column:
        return F.sum(w * x) / F.sum(w)

    out = rows.groupBy(*by).agg(
        mean_of(F.col("mean")).alias("mean"),
        mean_of(F.col("std") * F.col("std") + F.col("mean") * F.col("mean")).alias("square"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        *(
            [mean_of(F.col(q)).alias(q) for q in ("q01", "q99")]
            if method == "weighted_average"
            else [F.min("q01").alias("q01"), F.max("q99").alias("q99")]
        ),
        F.count(F.lit(1)).alias("n_datasets"),
    )
    variance = F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))
    return out.select(
        *by, "mean", F.sqrt(variance).alias("std"), "min", "max", "q01", "q99", "n_datasets"
    )


def config_agreement(configs: DataFrame, group: str, key: str, *fields: str) -> DataFrame:
    """Keys whose configuration differs inside a group (empty when everything agrees)."""
    return (
        configs.groupBy(group, key)
        .agg(F.count_distinct(F.struct(*fields)).alias("n_configs"))
        .where("n_configs > 1")
    )


def combine_keys(stats: DataFrame, group: str, key: str, order: str, dim: str) -> DataFrame:
    """Per group: the statistics of all keys laid end to end in declared order, with an action
    mask that is False on grippers. The arrays are as long as the action vector."""
    item = F.struct(
        F.col(order).alias("o"),
        F.col(dim).alias("d"),
        F.struct(*STATS, (~F.lower(F.col(key)).contains("gripper")).alias("mask")).alias("s"),
    )
    rows = stats.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("a"))
    s = F.col("a.s")
    return rows.select(group, *[s[n].alias(n) for n in (*STATS, "mask")])


def dataset_counts(episodes: DataFrame, tag: str, length: str) -> DataFrame:
    """Transitions and trajectories per tag."""
    return episodes.groupBy(tag).agg(
        F.sum(length).alias("num_transitions"), F.count(F.lit(1)).alias("num_trajectories")
    )


def calibrate_thresholds(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Median and 90 % quantile of a drift log as soft and hard threshold."""
    return exact_quantiles(df, keys, value, [0.5, 0.9]).select(
        *keys, F.col("q")[0].alias("tau_soft"), F.col("q")[1].alias("tau_hard")
    )


def sample_window_starts(
    episodes: DataFrame, keys: Sequence[str], length: str, window: int, k: int, seed: int
) -> DataFrame:
    """``k`` distinct window starts per episode, by hash order; short episodes have none.

    The per-episode rank filter is pushed below the shuffle by Spark's window group limit.
    """
    base = episodes.select(*keys, length)
    starts = explode_range(base, F.lit(0), F.col(length) - window + 1, "start")
    draw = hash_uniform(F.lit(seed), *[F.col(c) for c in keys], F.col("start"))
    w = Window.partitionBy(*keys).orderBy("draw", "start")
    return (
        starts.withColumn("draw", draw)
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= k)
        .select(*keys, "start")
    )


def delta_statistics(
    poses: DataFrame,
    key: str,
    index: str,
    pose: Sequence[str],
    window: int = 17,
    samples: int = 64,
    seed: int = 1234,
    anchor_zero: bool = False,
) -> DataFrame:
    """Per-dimension statistics of pose deltas inside sampled windows.

    A delta depends on two neighbouring frames only, so it is computed once per frame and weighted
    by the number of sampled windows that contain it. ``anchor_zero`` lets min and max include 0.
    """
    lengths = poses.groupBy(key).agg((F.max(index) + 1).alias("length"))
    starts = sample_window_starts(lengths, [key], "length", window, samples, seed)
    inside = starts.select(
        key, F.explode(F.sequence(F.col("start") + 1, F.col("start") + window - 1)).alias(index)
    )
    used = inside.groupBy(key, index).agg(F.count(F.lit(1)).alias("times"))
    deltas = pose_deltas(poses, [key], index, pose).join(used, [key, index])
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("dim"), F.col(f"d_{c}").alias("value"))
            for i, c in enumerate(pose)
        ]
    )
    rows = deltas.select("times", F.inline(pairs))
    rows = rows.select("dim", "value", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    out = column_statistics(rows, ["dim"])
    if anchor_zero:
        zero = F.lit(0.0)
        out = out.withColumns({"min": F.least("min", zero), "max": F.greatest("max", zero)})
    every = poses.sparkSession.range(len(pose)).select(F.col("id").cast("int").alias("dim"))
    return every.join(out, "dim", "left").fillna(0).select("dim", "n", *STATS)


def percentile_clip_normalise(
    df: DataFrame, keys: Sequence[str], value: str, low: float = 0.02, high: float = 0.98,
    name: str = "scaled",
) -> DataFrame:
    """Scale to [0, 1] between two quantiles of the group's positive values."""
    q = exact_quantiles(df.where(F.col(value) > 0), keys, F.col(value), [low, high]).select(
        *keys, F.col("q")[0].alias("__lo"), F.col("q")[1].alias("__hi")
    )
    q = small_side(q, "clip")
    x = (F.col(value) - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-3))
    return (
        df.join(q, list(keys), "left")
        .withColumn(name, F.coalesce(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))
        .drop("__lo", "__hi")
    )
