"""Principal components of wide vectors: block Krylov iteration over blocks of rows.

The covariance is never formed. Each round multiplies it with a few columns: tasks sum
``width x columns`` numbers over their blocks, and only these are shuffled. The columns seen so far span a
basis that grows until the leading directions in it no longer change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.scale import small_side
from epispark.session import materialise

BLOCK = 1024  # vectors of a block
HELD = 16  # groups whose sums a task holds at once
STATE = "key string, n long, mean array<double>, v array<double>, w array<double>, q array<double>, p array<double>, gap double"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, group, row, vector) sorted by key to blocks (key, group, rows, m, x)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        key = np.array(batch.column(0).to_pylist(), object)
        starts = np.union1d(np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), np.arange(0, n, BLOCK))
        cuts = np.r_[starts, n].astype(np.int32)
        vectors = batch.column(3)
        offsets = vectors.offsets.to_numpy()
        width = np.diff(offsets)
        if (width != np.repeat(width[starts], np.diff(cuts))).any():
            raise ValueError("vectors of a group differ in width")
        first = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(first), batch.column(1).take(first),
                pa.ListArray.from_arrays(pa.array(cuts), batch.column(2)), pa.array(np.diff(cuts).astype(np.int64)),
                pa.ListArray.from_arrays(pa.array((offsets - offsets[0])[cuts].astype(np.int32)), vectors.flatten()),
            ],
            names=["key", "group", "rows", "m", "x"],
        )


def _summed(value, columns: str):
    """Sum of ``value(row)`` over the blocks of a task, a row per key (more if a task has many keys)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out():
            return pd.DataFrame({"key": list(acc), "n": [a[0] for a in acc.values()], "y": [a[1].ravel() for a in acc.values()]})

        acc: dict = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n, y = acc.get(row.key, (0, 0.0))
                acc[row.key] = (n + row.m, y + value(row))
                if len(acc) > HELD:
                    yield out()
                    acc = {}
        if acc:
            yield out()

    return run, columns


def _product(row) -> np.ndarray:
    c = row.x.reshape(row.m, -1) - row.mean
    return c.T @ (c @ row.q.reshape(len(row.mean), -1))


def _start(columns: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].sum())
        mean = np.sum(np.stack(pdf["y"].to_numpy()), axis=0) / n
        q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(mean), min(columns, len(mean)))))
        none = np.zeros(0)
        return pd.DataFrame([{"key": pdf["key"].iloc[0], "n": n, "mean": mean, "v": q.ravel(), "w": none, "q": q.ravel(), "p": none, "gap": 1.0}])

    return run


def _step(k: int):
    """One round of a group: the product with the newest columns, the directions in the basis, new columns."""

    def run(parts: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if not len(parts) or not len(state):
            return state
        s = state.iloc[0]
        width = len(s["mean"])
        v, w = (np.asarray(s[c]).reshape(width, -1) for c in ("v", "w"))
        y = np.sum(np.stack(parts["y"].to_numpy()), axis=0).reshape(width, -1) / s["n"]
        w = np.hstack([w, y])
        t = v.T @ w
        value, u = np.linalg.eigh((t + t.T) / 2)
        value, u = value[::-1][:k], u[:, ::-1][:, :k]
        p = v @ u
        scale = max(value[0], np.finfo(float).tiny)
        gap = float(np.linalg.norm(w @ u - p * value, axis=0).max() / scale)
        q = y
        for _ in range(2):
            q = q - v @ (v.T @ q)
        q, r = np.linalg.qr(q)
        q = q[:, np.abs(np.diag(r)) > 1e-12 * scale][:, : width - v.shape[1]]
        q = q - v @ (v.T @ q)
        q, _ = np.linalg.qr(q)
        lead = np.take_along_axis(p, np.abs(p).argmax(axis=0)[None, :], axis=0)
        p = (p * np.where(lead < 0, -1.0, 1.0)).T
        return pd.DataFrame([{**s, "v": np.hstack([v, q]).ravel(), "w": w.ravel(), "q": q.ravel(), "p": p.ravel(), "gap": gap}])

    return run


def _scores(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # a batch may hold thousands of blocks: a few at a time, read in place
            for lo in range(0, whole.num_rows, HELD):
                yield scored(whole.slice(lo, HELD))

    def scored(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, parts = batch.column(3).to_numpy(), []
        for i, m in enumerate(sizes):
            x, mean, p = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (4, 5, 6))
            s = (x.reshape(m, -1) - mean) @ p.reshape(-1, len(mean)).T
            parts.append(np.hstack([s, np.full((m, k - s.shape[1]), np.nan)]))
        s = np.vstack(parts)
        who = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        columns = [pa.array(s[:, i], from_pandas=True) for i in range(k)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(who), batch.column(1).take(who), batch.column(2).flatten(), *columns],
            names=["key", "group", "row", *[f"pc{i}" for i in range(k)]],
        )

    return run


def directions(blocks: DataFrame, k: int, extra: int, tolerance: float, rounds: int, seed: int) -> DataFrame:
    """``key, mean, p`` of every group: its mean and its ``k`` leading directions, one after the other.

    ``gap`` is the largest residual against the leading variance; a group is settled when it is within the
    tolerance or when its basis spans the whole space. One number per round comes to the driver.
    """
    run, schema = _summed(lambda row: row.x.reshape(row.m, -1).sum(axis=0), "key string, n long, y array<double>")
    sums = blocks.select("key", "m", "x").mapInPandas(run, schema)
    state = materialise(sums.groupBy("key").applyInPandas(_start(k + extra, seed), STATE), "subspace")
    open_, settled = state, None
    for _ in range(rounds):
        run, schema = _summed(_product, "key string, n long, y array<double>")
        asked = open_.select(F.col("key").alias("k_"), "mean", "q")
        rows = blocks.select("key", "m", "x").join(asked, F.col("key") == F.col("k_")).drop("k_")
        parts = rows.mapInPandas(run, schema)
        state = parts.groupBy("key").cogroup(open_.groupBy("key")).applyInPandas(_step(k), STATE)
        state = materialise(state, "subspace")
        going = (F.col("gap") > tolerance) & (F.size("q") > 0)
        done = state.where(~going).select("key", "mean", "p")
        settled = done if settled is None else settled.unionByName(done)
        open_ = state.where(going)
        if open_.isEmpty():
            return settled
    raise RuntimeError(f"directions did not settle in {rounds} rounds")


def wide_components(
    df: DataFrame, group: str, row: str, vector: str, k: int = 3, extra: int = 8,
    tolerance: float = 1e-10, rounds: int = 60, seed: int = 7,
) -> DataFrame:
    """``group, row, pc0, ...``: principal scores of each vector within its group, scaled to [0, 1].

    The same values as :func:`epispark.operators.evaluation.principal_components`, without its
    ``width^2`` sums. Rows are packed into blocks where they lie, sorted by group within partitions only,
    so no row is shuffled and a group of any size spreads over all tasks that read it. The sign of a component
    makes its largest loading positive.

    Vectors that are null or hold null or non-finite components take no part; null groups are a group;
    repeated rows count each; components beyond a vector's width are null, and 0 where a group does not
    vary; an empty table gives an empty table. A group whose vectors differ in width is an error.
    """
    fields = {f.name: f.dataType for f in df.schema}
    x = F.col(vector).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(
        F.to_json(F.struct(F.col(group).alias("g"))).alias("key"), F.col(group).alias("group"), F.col(row).alias("row"), x.alias("vector")
    ).where(F.col(vector).isNotNull() & (F.size(x) > 0) & ~odd)
    schema = T.StructType(
        [
            T.StructField("key", T.StringType()), T.StructField("group", fields[group]),
            T.StructField("rows", T.ArrayType(fields[row])), T.StructField("m", T.LongType()),
            T.StructField("x", T.ArrayType(T.DoubleType())),
        ]
    )
    blocks = materialise(rows.sortWithinPartitions("key").mapInArrow(_to_blocks, schema), "vector-blocks")
    basis = directions(blocks, k, extra, tolerance, rounds, seed).withColumnRenamed("key", "k_")
    names = [f"pc{i}" for i in range(k)]
    given = blocks.join(basis, F.col("key") == F.col("k_")).select("group", "key", "rows", "m", "x", "mean", "p")
    given = given.select("key", "group", "rows", "m", "x", "mean", "p")
    out = T.StructType([*schema.fields[:2], T.StructField("row", fields[row]), *[T.StructField(c, T.DoubleType()) for c in names]])
    scores = materialise(given.mapInArrow(_scores(k), out), "scores")
    bounds = scores.groupBy(F.col("key").alias("k_")).agg(
        *[F.min(c).alias("lo_" + c) for c in names], *[F.max(c).alias("hi_" + c) for c in names]
    )
    scaled = [
        ((F.col(c) - F.col("lo_" + c)) / F.greatest(F.col("hi_" + c) - F.col("lo_" + c), F.lit(1e-6))).alias(c) for c in names
    ]
    both = scores.join(small_side(bounds, "bounds"), F.col("key") == F.col("k_"))
    return both.select(F.col("group").alias(group), F.col("row").alias(row), *scaled)
