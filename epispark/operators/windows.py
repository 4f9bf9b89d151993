"""Window operators along the frame index of an episode.

All of them take ``keys`` (the episode key columns) and ``index`` (dense 0-based frame number) and
run on bounded blocks, see :mod:`epispark.scale`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.functions import rotation as rot
from epispark.functions.ids import hash_uniform
from epispark.functions.vectors import wrap_angle
from epispark.scale import (
    BLOCK, Halo, explode_range, fill, global_rank, in_key_order, prefix_sum,
)


def finite_difference(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    linear: Sequence[str],
    angular: Sequence[str],
    fps: float,
    prefix: str = "v_",
    size: int = BLOCK,
) -> DataFrame:
    """Forward difference times fps; the last frame repeats the velocity before it, a single
    frame gets zeros. Angular differences are wrapped into ``[-pi, pi)`` first."""
    halo = Halo(df, keys, index, before=1, after=1, size=size)
    out = {}
    for c in [*linear, *angular]:
        x = F.col(c)
        ahead, behind = halo.at(x, 1) - x, x - halo.at(x, -1)
        if c in angular:
            ahead, behind = wrap_angle(ahead), wrap_angle(behind)
        out[prefix + c] = F.coalesce(ahead, behind, F.lit(0.0)) * fps
    return halo.close(halo.df.withColumns(out))


def boundary_flag(
    df: DataFrame, keys: Sequence[str], index: str, text: str, name: str, size: int = BLOCK
) -> DataFrame:
    """True where a non-empty text differs from the previous frame; False on the first frame."""
    halo = Halo(df, keys, index, before=1, size=size)
    x = F.col(text)
    flag = F.coalesce((x != halo.at(x, -1)) & (x != ""), F.lit(False))
    return halo.close(halo.df.withColumn(name, flag))


def gather_offsets(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    values: dict[str, Column],
    offsets: Sequence[int],
    padding: str = "first_last",
    mask: Column | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """Arrays of values at relative frame offsets.

    Outside the episode the first/last row (``first_last``) or zero (``zero``) is used and the
    ``mask`` array is False.
    """
    if padding not in ("first_last", "zero"):
        raise ValueError(f"unknown padding: {padding}")
    halo = Halo(
        df, keys, index, max(0, -min(offsets)), max(0, max(offsets)), size
    )
    out = {}
    for name, x in values.items():
        picks = [
            halo.clamped(x, o) if padding == "first_last" else halo.at(x, o, F.lit(0.0))
            for o in offsets
        ]
        out[name] = F.array(*picks)
    valid = F.lit(True) if mask is None else mask
    out["mask"] = F.array(*[F.coalesce(halo.at(valid, o), F.lit(False)) for o in offsets])
    return halo.close(halo.df.withColumns(out))


def clamp_offsets(t: Column, offsets: Sequence[int], length: Column) -> Column:
    """Frame numbers ``t + offset`` moved into ``[0, length)``."""
    return F.array(*[F.least(F.greatest(t + o, F.lit(0)), length - 1) for o in offsets])


def next_block(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    value: str,
    k: int,
    name: str,
    size: int = BLOCK,
) -> DataFrame:
    """The current and following ``k - 1`` values, zero-padded at the end of the episode."""
    halo = Halo(df, keys, index, after=k - 1, size=size)
    ahead = F.collect_list(value).over(halo.rows(0, k - 1))
    zero = F.lit(0.0)
    padded = F.concat(ahead, F.array_repeat(zero, F.lit(k) - F.size(ahead)))
    return halo.close(halo.df.withColumn(name, padded))


def sample_index(
    episodes: DataFrame,
    key: str,
    length: str,
    history: int = 4,
    future: int = 8,
    action_block: int = 16,
    fps_action: int = 30,
    fps_features: int = 5,
) -> DataFrame:
    """Frames that may be drawn as samples: from the history lead-in in steps of the stride up to
    the tail reserve; at least one candidate per episode, dropped when past the episode's end.
    When no episode has a sample, every episode gives frame 0."""
    stride = max(fps_action // fps_features, 1)
    lo = (history - 1) * stride
    hi = F.col(length) - max(action_block, future * stride)
    base = episodes.select(key, length)
    end = F.greatest(F.lit(lo + 1), hi)
    picks = explode_range(base, F.lit(lo), end, "t", stride)
    picks = picks.where(F.col("t") < F.col(length)).select(key, "t")
    any_pick = picks.agg(F.count(F.lit(1)).alias("n")).scalar()
    fallback = episodes.where(any_pick == 0).select(key, F.lit(0).cast("long").alias("t"))
    return picks.unionByName(fallback)


def every_interval(episodes: DataFrame, key: str, length: str, interval: int) -> DataFrame:
    """Frame numbers 0, interval, 2*interval, ... of every non-empty episode."""
    base = episodes.select(key, length)
    return explode_range(base, F.lit(0), F.col(length), "t", interval).select(key, "t")


def pose_deltas(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    pose: Sequence[str],
    prefix: str = "d_",
    size: int = BLOCK,
) -> DataFrame:
    """Relative transform of each frame to the one before it as xyz+rpy; the first frame of an
    episode has none and is dropped."""
    rt = with_rigid(df, pose)
    halo = Halo(rt, keys, index, before=1, size=size)
    prev = F.lag(F.struct(*_RT)).over(halo.w)
    rows = halo.close(halo.df.withColumn("__p", prev)).where(F.col(index) > 0)
    # staged projections: each stage reuses the columns of the one before
    inv = rot.transpose(_rot_of("__p.m"))
    shift = [F.col(f"m{4 * i + 3}") - F.col(f"__p.m{4 * i + 3}") for i in range(3)]
    product = rot.matmul(inv, _rot_of("m"))
    staged = {f"__q{i}{j}": product[i][j] for i in range(3) for j in range(3)}
    rows = rows.withColumns({**staged, **{f"__t{i}": x for i, x in enumerate(rot.matvec(inv, shift))}})
    rpy = rot.matrix_to_rpy([[F.col(f"__q{i}{j}") for j in range(3)] for i in range(3)])
    out = [*[F.col(f"__t{i}") for i in range(3)], *rpy]
    return rows.select(*df.columns, *[x.alias(prefix + c) for c, x in zip(pose, out)])


_RT = [f"m{i}" for i in range(12)]


def _rot_of(prefix: str) -> rot.Matrix:
    return [[F.col(f"{prefix}{4 * i + j}") for j in range(3)] for i in range(3)]


def with_rigid(df: DataFrame, pose: Sequence[str]) -> DataFrame:
    """Add the rigid transform of an xyz+rpy pose as the row-major 3x4 columns ``m0..m11``."""
    trig = {}
    for a, c in zip("rpw", pose[3:6]):
        trig[f"__s{a}"], trig[f"__c{a}"] = F.sin(c), F.cos(c)
    m = rot.matrix_from_trig(*[F.col(n) for n in trig])
    entries = {
        _RT[4 * i + j]: (m[i][j] if j < 3 else F.col(pose[i])) for i in range(3) for j in range(4)
    }
    return df.withColumns(trig).withColumns(entries).drop(*trig)


def _flat(mats: np.ndarray) -> dict[str, np.ndarray]:
    flat = mats[:, :3, :].reshape(-1, 12)
    return {n: flat[:, i] for i, n in enumerate(_RT)}


def _unflat(pdf: pd.DataFrame) -> np.ndarray:
    out = np.tile(np.eye(4), (len(pdf), 1, 1))
    out[:, :3, :] = pdf[_RT].to_numpy(float).reshape(-1, 3, 4)
    return out


def _segmented_products(mats: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Running matrix products that restart wherever a segment starts (doubling steps, all
    segments at once); ``start`` is each row's segment start position."""
    at = np.arange(len(mats))
    reach, longest = 1, int((at - start).max(initial=0)) + 1
    while reach < longest:
        ok = np.flatnonzero(at - reach >= start)
        nxt = mats.copy()
        nxt[ok] = mats[ok - reach] @ mats[ok]
        mats, reach = nxt, reach * 2
    return mats


def _scan_products(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Running product of the rigid transforms ``m0..m11`` per key group in ``order``.

    Groups are hash-partitioned and sorted by Spark; Arrow batches stream through each task with
    only the last product carried over, so no group is held in memory.
    """

    def scan(batches):
        last_key, acc = None, np.eye(4)
        for pdf in batches:
            if len(pdf) == 0:
                continue
            ids = pdf[list(keys)]
            new = (ids != ids.shift()).any(axis=1).to_numpy()
            first_key = tuple(ids.iloc[0])
            new[0] = True
            start = np.maximum.accumulate(np.where(new, np.arange(len(pdf)), 0))
            mats = _segmented_products(_unflat(pdf), start)
            if first_key == last_key:
                head = start == 0
                mats[head] = acc @ mats[head]
            last_key, acc = tuple(ids.iloc[-1]), mats[-1]
            yield pdf.assign(**_flat(mats))

    return in_key_order(df, keys, order).mapInPandas(scan, df.schema)


def integrate_deltas(
    deltas: DataFrame,
    initial: DataFrame,
    key: str,
    index: str,
    delta_cols: Sequence[str],
    pose_cols: Sequence[str],
    size: int = BLOCK,
) -> DataFrame:
    """Absolute poses from an initial pose and per-frame deltas (inverse of :func:`pose_deltas`).

    The product of rigid transforms is associative: each block is multiplied on its own, block
    totals are multiplied per episode (one row per block), and the two are combined in the JVM.
    """
    blocks = with_rigid(deltas, delta_cols).select(
        key, index, F.floor(F.col(index) / size).alias("block"), *_RT
    )
    part = _scan_products(blocks, [key, "block"], index)
    totals = (
        part.groupBy(key, "block")
        .agg(F.max_by(F.struct(*_RT), index).alias("m"))
        .select(key, "block", "m.*")
    )
    origin = with_rigid(initial, pose_cols).select(
        key, F.lit(-1).cast("long").alias("block"), *_RT
    )
    carries = _scan_products(origin.unionByName(totals), [key], "block")
    carries = carries.select(
        key, (F.col("block") + 1).alias("block"), *[F.col(n).alias("c" + n) for n in _RT]
    )
    joined = part.join(carries, [key, "block"], "left")

    def pos(p: str):
        return [F.col(f"{p}m{4 * i + 3}") for i in range(3)]

    where = [a + b for a, b in zip(rot.matvec(_rot_of("cm"), pos("")), pos("c"))]
    product = rot.matmul(_rot_of("cm"), _rot_of("m"))
    joined = joined.withColumns({f"__q{i}{j}": product[i][j] for i in range(3) for j in range(3)})
    angles = rot.matrix_to_rpy([[F.col(f"__q{i}{j}") for j in range(3)] for i in range(3)])
    rows = joined.select(key, index, *[x.alias(c) for x, c in zip([*where, *angles], pose_cols)])
    first = initial.select(key, F.lit(0).cast("long").alias(index), *pose_cols)
    return first.unionByName(rows)


def trailing_mean_padded(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    values: Sequence[str],
    window: int = 16,
    prefix: str = "m_",
    size: int = BLOCK,
) -> DataFrame:
    """Mean over the last ``window`` frames; missing early frames count as the current value."""
    halo = Halo(df, keys, index, before=window - 1, size=size)
    frame = halo.rows(-(window - 1), 0)
    n = F.count(F.lit(1)).over(frame)
    out = {
        prefix + c: (F.sum(c).over(frame) + (F.lit(window) - n) * F.col(c)) / window
        for c in values
    }
    return halo.close(halo.df.withColumns(out))


def moving_average(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    value: str,
    window: int,
    name: str,
    size: int = BLOCK,
) -> DataFrame:
    """Trailing mean over the available rows."""
    halo = Halo(df, keys, index, before=window - 1, size=size)
    return halo.close(halo.df.withColumn(name, F.avg(value).over(halo.rows(-(window - 1), 0))))


def history_stack(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    values: dict[str, Column],
    offsets: Sequence[int],
    size: int = BLOCK,
) -> DataFrame:
    """Stack of past rows at non-positive, evenly spaced offsets ending at 0; before the episode
    starts the first observation is repeated."""
    steps = {b - a for a, b in zip(offsets, offsets[1:])}
    if offsets[-1] != 0 or max(offsets) > 0 or len(steps) > 1 or min(steps or {1}) <= 0:
        raise ValueError("offsets must be evenly spaced, non-positive and end at 0")
    return gather_offsets(df, keys, index, values, offsets, "first_last", size=size).drop("mask")


def next_state(values: Column, history: int | None = None) -> Column:
    """Drop the first entry, of the history and of the prediction part separately."""
    if history is None:
        return F.slice(values, 2, F.size(values))
    return F.concat(
        F.slice(values, 2, history - 1),
        F.slice(values, history + 2, F.greatest(F.size(values) - history - 1, F.lit(0))),
    )


def delta_parts(values: Column, history: int | None, invert: Column | None = None) -> Column:
    """Gripper or hand channel of a delta action: optionally inverted, then :func:`next_state`."""
    x = values
    if invert is not None:
        x = F.transform(values, lambda v: F.when(invert, 1 - v).otherwise(v))
    return next_state(x, history)


def ensemble_predictions(
    preds: DataFrame, keys: Sequence[str], made_at: str, ahead: str, vector: str,
    horizon: int, alpha: float = 0.0, eps: float = 1e-7,
) -> DataFrame:
    """Weighted mean of the predictions for each step made at it or within the horizon before.

    Weights are a softmax of ``alpha`` times the cosine to the newest prediction. A step has at most
    ``horizon`` predictions, so the per-step lists are bounded.
    """
    step = F.col(made_at) + F.col(ahead)
    rows = preds.where((F.col(ahead) >= 0) & (F.col(ahead) < horizon)).withColumn("step", step)
    lists = rows.groupBy(*keys, "step").agg(
        F.array_sort(F.collect_list(F.struct(made_at, F.col(vector).alias("v")))).alias("p"),
        F.max_by(vector, made_at).alias("ref"),
        F.max(made_at).alias("newest"),
    )

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def weighted(p):
        cos = dot(p["v"], F.col("ref")) / (
            F.sqrt(dot(p["v"], p["v"])) * F.sqrt(dot(F.col("ref"), F.col("ref"))) + eps
        )
        return F.struct(F.exp(alpha * cos).alias("w"), p["v"].alias("v"))

    scored = lists.where(F.col("newest") == F.col("step")).withColumn(
        "s", F.transform("p", weighted)
    )
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"])
    summed = F.aggregate(
        "s",
        F.transform("ref", lambda _: F.lit(0.0)),
        lambda acc, x: F.zip_with(acc, x["v"], lambda a, b: a + x["w"] * b),
    )
    return scored.withColumn("total", total).select(
        *keys,
        "step",
        F.size("p").alias("n_preds"),
        F.transform(summed, lambda x: x / F.col("total")).alias("action"),
    )


def pick_stale_snapshot(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    refreshed: Column,
    seed: int,
    p: float = 0.5,
    max_age: int = 60,
    history: int = 8,
    name: str = "snapshot",
    size: int = BLOCK,
) -> DataFrame:
    """Frame of the snapshot in use: with probability ``p`` one of the last ``history`` snapshots
    of age at most ``max_age``, otherwise (or when there is none) the live one, i.e. the newest of
    any age; null only before the first refresh."""
    block = F.floor(F.col(index) / size)
    df = fill(df, keys, [index], block, F.when(refreshed, F.col(index)), "__live")
    halo = Halo(df, keys, index, before=max_age, size=size)
    snaps = F.collect_list(F.when(refreshed, F.col(index))).over(halo.rows(-max_age, 0))
    rows = halo.close(halo.df.withColumn("__s", snaps))
    recent = F.slice("__s", -history, history)
    rows = rows.withColumn(
        "__s", F.when(F.size("__s") > history, recent).otherwise(F.col("__s"))
    )
    coin = hash_uniform(F.lit(seed), *[F.col(k) for k in keys], F.col(index), F.lit("coin"))
    draw = hash_uniform(F.lit(seed), *[F.col(k) for k in keys], F.col(index), F.lit("pick"))
    live = F.col("__live")
    stale = F.get("__s", F.floor(draw * F.size("__s")).cast("int"))
    picked = F.when((coin < p) & (F.size("__s") > 0), stale).otherwise(live)
    return rows.withColumn(name, picked).drop("__s", "__live")


def global_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Dense 0-based index over the whole table in the order of unique columns."""
    return global_rank(df, order, name)


def start_offsets(
    df: DataFrame, order: str, length: str, name: str, bucket_rows: int = 1 << 16
) -> DataFrame:
    """Exclusive prefix sum of lengths over the whole table in id order."""
    bucket = F.floor(F.col(order) / bucket_rows)
    return prefix_sum(df, [], [order], [bucket], F.col(length), name)


def retained_checkpoints(
    df: DataFrame, run: str, step: str, score: str, keep: int = 3, higher_is_better: bool = False
) -> DataFrame:
    """Newest ``keep`` steps of each run plus its best-scored step (earliest on ties)."""
    w = Window.partitionBy(run).orderBy(F.col(step).desc())
    newest = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= keep)
    rank = F.struct((-F.col(score) if higher_is_better else F.col(score)), F.col(step))
    best = df.groupBy(run).agg(F.min_by(F.struct(step, score), rank).alias("b")).select(run, "b.*")
    return (
        newest.select(run, step, score, F.lit(False).alias("best"))
        .unionByName(best.withColumn("best", F.lit(True)))
        .groupBy(run, step, score)
        .agg(F.bool_or("best").alias("is_best"))
    )


def pad_episodes(
    df: DataFrame, keys: Sequence[str], index: str, multiple: int, last: Sequence[str] = (),
    first: Sequence[str] = (),
) -> DataFrame:
    """Episodes continued to a whole multiple of frames, holding values of their last or first frame.

    Needs a dense index from 0. The ends of an episode come from one hash aggregate per key and an
    episode gains less than ``multiple`` rows, so its frames are neither sorted nor gathered.
    """
    ends = df.groupBy(*keys).agg(
        (F.max(index) + 1).alias("__n"),
        *[F.max_by(c, index).alias(c) for c in last],
        *[F.min_by(c, index).alias(c) for c in first],
    )
    stop = F.ceil(F.col("__n") / multiple) * multiple
    more = ends.where(F.col("__n") < stop).select(
        *keys, F.explode(F.sequence(F.col("__n"), stop - 1)).alias(index), *last, *first
    )
    return df.select(*keys, index, *last, *first).unionByName(more)


def future_trajectory(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    position: Sequence[str],
    rotation: Sequence[str],
    horizon: int,
    size: int = BLOCK,
) -> DataFrame:
    """Positions of the next ``horizon`` frames and the rotation in force at each of them: an
    all-zero rotation entry keeps the previous one (the current frame's at the start)."""
    halo = Halo(df, keys, index, after=horizon, size=size)
    angles = F.struct(*[F.col(c) for c in rotation])
    turned = F.lit(False)
    for c in rotation:
        turned = turned | (F.col(c) != 0)
    item = F.struct(
        *[F.col(c) for c in position], F.when(turned, angles).alias("rot"), angles.alias("raw")
    )
    rows = halo.close(halo.df.withColumn("path", F.collect_list(item).over(halo.rows(0, horizon))))

    def held(p, i):
        upto = F.filter(F.slice("path", 2, i), lambda q: q["rot"].isNotNull())
        first = F.get("path", F.lit(0))["raw"]
        return F.struct(
            i.alias("h"),
            *[p[c].alias(c) for c in position],
            F.coalesce(F.try_element_at(upto, F.lit(-1))["rot"], first).alias("rot"),
        )

    return rows.withColumn("path", F.transform("path", held))
