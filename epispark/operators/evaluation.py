"""Quality metrics over prediction tables, run logs and embedding tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.functions.vectors import angular_diff, dot, norm

# fixed values: which dims of an action are position, orientation, gripper or hand, by its width
TWO_ARM_GRIPPER = {"position": [0, 1, 2, 7, 8, 9], "orientation": [3, 4, 5, 10, 11, 12],
                   "gripper": [6, 13]}
TWO_ARM = {"position": [0, 1, 2, 6, 7, 8], "orientation": [3, 4, 5, 9, 10, 11]}


def error_groups(width: int) -> dict[str, list[int]]:
    if width == 14:
        return TWO_ARM_GRIPPER
    groups = dict(TWO_ARM)
    if width > 14:
        groups["hand"] = list(range(12, width))
    return groups


def pair_predictions(
    truth: DataFrame, preds: DataFrame, keys: Sequence[str], gt: str, pred: str
) -> DataFrame:
    """Inner join of truth and prediction rows; both vectors cut to their common width."""
    both = truth.join(preds, list(keys))
    width = F.least(F.size(gt), F.size(pred))
    return both.withColumns({gt: F.slice(gt, 1, width), pred: F.slice(pred, 1, width)})


def grouped_mae(df: DataFrame, keys: Sequence[str], gt: Column, pred: Column, width: int):
    """Mean absolute error of position, wrapped orientation, gripper or hand dims per key."""
    out = []
    groups = error_groups(width)
    for name in ("position", "orientation", "gripper", "hand"):
        total = F.lit(None).cast("double")
        if name in groups:
            terms = []
            for d in groups[name]:
                g, p = F.get(gt, F.lit(d)), F.get(pred, F.lit(d))
                terms.append(F.abs(angular_diff(g, p) if name == "orientation" else g - p))
            total = sum(terms[1:], terms[0]) / len(terms)
        out.append(F.avg(total).alias(f"{name}_l1_loss"))
    return df.groupBy(*keys).agg(*out)


def l2(gt: Column, pred: Column) -> Column:
    diff = F.zip_with(gt, pred, lambda a, b: a - b)
    return F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x))


def open_loop_steps(df: DataFrame, sample: str, step: str, gt: str, pred: str) -> DataFrame:
    """Mean L2 per horizon step over all samples; a sample without the step counts as 0."""
    n = df.agg(F.count_distinct(sample).alias("n")).scalar()
    return (
        df.groupBy(step)
        .agg(F.sum(l2(F.col(gt), F.col(pred))).alias("total"))
        .select(step, (F.col("total") / n).alias("mean_l2"))
    )


def open_loop_summary(
    df: DataFrame, sample: str, episode: str, step: str, gt: str, pred: str
) -> DataFrame:
    """ADE (mean of the steps), FDE (last step), number of samples and distinct episodes."""
    steps = open_loop_steps(df, sample, step, gt, pred)
    counts = df.agg(
        F.struct(
            F.count_distinct(sample).alias("samples"), F.count_distinct(episode).alias("episodes")
        )
    ).scalar()
    return steps.agg(
        F.avg("mean_l2").alias("ade"), F.max_by("mean_l2", step).alias("fde")
    ).select(
        "ade", "fde", counts["samples"].alias("n_samples"),
        counts["episodes"].alias("n_episodes"),
    )


def episode_success(df: DataFrame, keys: Sequence[str], done: Column) -> DataFrame:
    """Success (any step) and length per episode."""
    return df.groupBy(*keys).agg(
        F.bool_or(done).alias("success"), F.count(F.lit(1)).alias("length")
    )


def success_rate(episodes: DataFrame, *by: str) -> DataFrame:
    return episodes.groupBy(*by).agg(
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg("length").alias("mean_length"),
        F.count(F.lit(1)).alias("n_episodes"),
    )


REDUCERS = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}


def reduce_steps(
    df: DataFrame, keys: Sequence[str], index: str, value: str, every: int, method: str
) -> DataFrame:
    """Signal reduced over blocks of ``every`` consecutive steps."""
    if method not in REDUCERS:
        raise ValueError(f"unknown reduction: {method}")
    return df.groupBy(*keys, F.floor(F.col(index) / every).alias("macro_step")).agg(
        REDUCERS[method](value).alias("value")
    )


def batch_health(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Sample deviation of all values of a batch (null for a single value)."""
    return df.groupBy(*keys).agg(F.stddev_samp(value).alias("std"))


def run_summary(df: DataFrame, run: str, step: str, loss: str, last: int = 50) -> DataFrame:
    """Best loss, mean of the last ``last`` steps, final loss and number of steps per run."""
    w = Window.partitionBy(run).orderBy(F.col(step).desc())
    tail = (
        df.withColumn("__r", F.row_number().over(w))
        .where(F.col("__r") <= last)
        .groupBy(run)
        .agg(F.avg(loss).alias("mean_last"))
    )
    whole = df.groupBy(run).agg(
        F.min(loss).alias("best_loss"),
        F.max_by(loss, step).alias("final_loss"),
        F.count(F.lit(1)).alias("n_steps"),
    )
    return whole.join(tail, run)


def embedding_health(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean norm and mean off-diagonal cosine of a group of vectors.

    The pair mean equals ``(|sum of unit vectors|^2 - sum of |unit|^2) / (n (n - 1))``, so only
    per-dimension sums are aggregated and no pair is formed.
    """
    rows = df.select(
        *keys,
        norm(F.col(vector)).alias("__n"),
        F.col(vector).alias("__v"),
    ).withColumn("__u", F.transform("__v", lambda x: x / F.greatest("__n", F.lit(1e-8))))
    heads = rows.groupBy(*keys).agg(
        F.avg("__n").alias("norm_mean"),
        F.count(F.lit(1)).alias("n"),
        F.sum(dot(F.col("__u"), F.col("__u"))).alias("self"),
    )
    sums = (
        rows.select(*keys, F.posexplode("__u").alias("dim", "x"))
        .groupBy(*keys, "dim")
        .agg(F.sum("x").alias("s"))
        .groupBy(*keys)
        .agg(F.sum(F.col("s") * F.col("s")).alias("total"))
    )
    pairs = F.col("n") * (F.col("n") - 1)
    return heads.join(sums, list(keys)).select(
        *keys,
        "n",
        "norm_mean",
        F.when(F.col("n") >= 2, (F.col("total") - F.col("self")) / pairs).alias("pairwise_cos"),
    )


def masked_mse(pred: Column, target: Column, mask: Column) -> Column:
    m = mask.cast("double")
    return F.sum(m * (pred - target) * (pred - target)) / F.greatest(F.sum(m), F.lit(1e-8))


def masked_bce(logit: Column, label: Column, mask: Column) -> Column:
    """Binary cross-entropy on logits in its stable form, averaged under a mask."""
    m = mask.cast("double")
    loss = F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))
    return F.sum(m * loss) / F.greatest(F.sum(m), F.lit(1e-8))


def batch_composition(df: DataFrame, batch: str, task: str, tag: str, fingerprint: str):
    """Rows per task and embodiment of a batch and the distinct contents among them."""
    return df.groupBy(batch, task, tag).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(fingerprint).alias("n_distinct")
    )


def averages_with_total(df: DataFrame, tag: str, *metrics: str) -> DataFrame:
    """Null-aware metric means per tag plus one overall row (tag null)."""
    return df.rollup(tag).agg(
        *[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n_trajectories")
    )


def mean_action_distance(df: DataFrame, keys: Sequence[str], gt: str, pred: str) -> DataFrame:
    """Euclidean distance over all elements of a batch divided by the number of elements."""
    diff = F.zip_with(F.col(gt), F.col(pred), lambda a, b: a - b)
    squares = F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)
    return df.groupBy(*keys).agg(
        (F.sqrt(F.sum(squares)) / F.sum(F.size(gt))).alias("mean_distance")
    )


CELLS = 1 << 20  # comparisons that a task holds at once


def _soft_ranks(x: np.ndarray, tau: float) -> np.ndarray:
    """Smooth rank in each row: one plus the sigmoid comparisons with all other elements of the row."""
    rows, n = x.shape
    out = np.empty_like(x)
    step = max(1, CELLS // max(1, rows * n))
    for lo in range(0, n, step):
        with np.errstate(over="ignore"):
            out[:, lo : lo + step] = (1.0 / (1.0 + np.exp((x[:, lo : lo + step, None] - x[:, None, :]) / tau))).sum(axis=2)
    return out + 0.5


def soft_spearman(a: Column, b: Column, tau: float = 1.0, eps: float = 1e-8) -> Column:
    """Smooth rank correlation of two equally long arrays of one row (Arrow batches); null if one is null.

    Rows of one length are ranked together as a matrix, as many as ``CELLS`` comparisons allow.
    """
    if tau <= 0:
        raise ValueError("tau must be positive")

    @F.pandas_udf(T.DoubleType())
    def rho(left: pd.Series, right: pd.Series) -> pd.Series:
        there = np.flatnonzero((left.notna() & right.notna()).to_numpy())
        size = np.array([len(left.iloc[i]) for i in there], int)
        out = np.full(len(left), np.nan)
        for n in np.unique(size):
            same, many = there[size == n], max(1, CELLS // max(1, int(n) ** 2))
            for lo in range(0, len(same), many):
                at = same[lo : lo + many]
                x, y = (_soft_ranks(np.stack(v.iloc[at].to_numpy()).astype(float), tau) for v in (left, right))
                x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
                den = np.sqrt(((x**2).sum(axis=1) + eps) * ((y**2).sum(axis=1) + eps))
                out[at] = (x * y).sum(axis=1) / den
        return pd.Series(out)

    return rho(a, b)


def info_nce(
    df: DataFrame, batch: str, order: str, student: str, teacher: str, batch_rows: int,
    temperature: float = 0.07,
) -> DataFrame:
    """Symmetric contrastive score per batch of at most ``batch_rows`` rows.

    The bound is checked: a larger batch is an error, because its similarity matrix would be too.
    """
    key_type = df.schema[batch].dataType.simpleString()

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > batch_rows:
            raise ValueError(f"batch has {len(pdf)} rows, more than {batch_rows}")
        pdf = pdf.sort_values(order)
        s, t = (np.stack(pdf[c].to_numpy()).astype(float) for c in (student, teacher))
        s, t = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (s, t))
        logits = s @ t.T / temperature
        both = 0.0
        for m in (logits, logits.T):
            top = m.max(axis=1, keepdims=True)
            lse = np.log(np.exp(m - top).sum(axis=1)) + top[:, 0]
            both += float((lse - np.diag(m)).mean())
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "n": [len(pdf)], "loss": [both / 2]})

    return df.groupBy(batch).applyInPandas(score, f"{batch} {key_type}, n long, loss double")


def paired_mse(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Mean squared error over all elements of paired vectors."""
    diff = F.zip_with(F.col(a), F.col(b), lambda x, y: x.cast("double") - y.cast("double"))
    sq = F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)
    return df.groupBy(*keys).agg((F.sum(sq) / F.sum(F.size(a))).alias("mse"))


def channel_order(
    df: DataFrame, keys: Sequence[str], frame: str, pixels: str, threshold: float = 5.0
) -> DataFrame:
    """Decide from the middle frame whether the first and last channel are swapped.

    Only the middle frame's pixels are shuffled. Status: keep, swap or ambiguous.
    """
    middle = df.groupBy(*keys).agg(F.floor((F.max(frame) + 1) / 2).alias(frame))
    rows = df.join(middle, [*keys, frame])

    def mean_of(c: int) -> Column:
        total = F.aggregate(pixels, F.lit(0.0), lambda s, p: s + F.get(p, F.lit(c)))
        return total / F.size(pixels)

    gap = mean_of(0) - mean_of(2)
    # a blue-first frame averages higher in its first channel
    status = (
        F.when(F.abs(gap) < threshold, "ambiguous").when(gap > 0, "swap").otherwise("keep")
    )
    return rows.select(*keys, gap.alias("gap"), status.alias("status"))


def principal_components(
    df: DataFrame, group: str, row: str, vector: str, width: int, k: int = 3
) -> DataFrame:
    """First ``k`` principal scores of each row's vector within its group, scaled to [0, 1].

    Each task sums counts, vectors and their outer products per group; only these partial sums
    (``width^2`` numbers) are shuffled, so group size does not matter. The sign of a component is
    fixed by making its largest loading positive.
    """
    gtype = df.schema[group].dataType.simpleString()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for pdf in batches:
            for g, rows in pdf.groupby(group):
                x = np.stack(rows[vector].to_numpy()).astype(float)
                n, s, q = acc.get(g, (0, 0.0, 0.0))
                acc[g] = (n + len(x), s + x.sum(axis=0), q + x.T @ x)
        if acc:
            yield pd.DataFrame(
                {
                    group: list(acc),
                    "n": [v[0] for v in acc.values()],
                    "s": [v[1] for v in acc.values()],
                    "q": [v[2].ravel() for v in acc.values()],
                }
            )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].sum()
        mean = np.sum(np.stack(pdf["s"].to_numpy()), axis=0) / n
        gram = np.sum(np.stack(pdf["q"].to_numpy()), axis=0).reshape(width, width)
        _, vectors = np.linalg.eigh(gram / n - np.outer(mean, mean))
        comps = vectors[:, ::-1][:, :k].T
        lead = np.take_along_axis(comps, np.abs(comps).argmax(axis=1)[:, None], axis=1)
        comps = comps * np.sign(lead)
        return pd.DataFrame(
            {group: [pdf[group].iloc[0]], "mean": [mean], "comps": [[list(c) for c in comps]]}
        )

    sums = df.select(group, vector).mapInPandas(
        partial, f"{group} {gtype}, n long, s array<double>, q array<double>"
    )
    basis = sums.groupBy(group).applyInPandas(
        solve, f"{group} {gtype}, mean array<double>, comps array<array<double>>"
    )
    centred = F.zip_with(F.col(vector), F.col("mean"), lambda x, m: x - m)
    scores = df.join(basis, group).select(
        group, row, *[dot(centred, F.col("comps")[i]).alias(f"pc{i}") for i in range(k)]
    )
    names = [f"pc{i}" for i in range(k)]
    bounds = scores.groupBy(group).agg(
        *[F.min(c).alias("lo_" + c) for c in names], *[F.max(c).alias("hi_" + c) for c in names]
    )
    scaled = [
        (
            (F.col(c) - F.col("lo_" + c))
            / F.greatest(F.col("hi_" + c) - F.col("lo_" + c), F.lit(1e-6))
        ).alias(c)
        for c in names
    ]
    return scores.join(bounds, group).select(group, row, *scaled)
