"""Smooth ranks and their correlation in groups of any size.

The smooth rank of a row is the sum of ``sigmoid((x - y) / tau)`` over the rows ``y`` of its group.
Values are cut into cells of half a ``tau``. Inside a cell the sigmoid is a polynomial to double
precision, so a cell is known by its count and a few power sums; cells more than 40 tau apart count as
0 or 1. Sums go map-side, fields are computed per cell in blocks with a halo, and each row evaluates
one polynomial: no pairs of rows, whatever a group's size.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.session import materialise

TERMS = 12
REACH = 81  # cells of half a tau: beyond them the sigmoid is 0 or 1 to 4e-18
CELLS = 512  # cells of a block


@functools.lru_cache(maxsize=1)
def _kernels() -> tuple[np.ndarray, np.ndarray]:
    """Power sums to node weights, and the fields of a cell's nodes on those of the cells around it."""
    z = np.cos(np.pi * (np.arange(TERMS) + 0.5) / TERMS)
    powers = np.vander(z, TERMS, increasing=True)
    d = np.arange(-REACH, REACH + 1)[:, None, None]
    gap = -d / 2 + (z[None, None, :] - z[None, :, None]) / 4  # [offset, source node, target node]
    return powers, 1 / (1 + np.exp(-gap))


def _fields(block: pd.DataFrame) -> pd.DataFrame:
    """Polynomials of the block's own cells from all cells of the block and its halo."""
    powers, kernel = _kernels()
    first = int(block["block"].iloc[0]) * CELLS - REACH
    at = block["cell"].to_numpy(np.int64) - first
    sums = np.zeros((CELLS + 2 * REACH, TERMS))
    sums[at] = np.stack(block["sums"].to_numpy())
    weights = np.linalg.solve(powers.T, sums.T).T
    before = np.r_[0, np.cumsum(sums[:, 0])]
    own = np.flatnonzero((at >= REACH) & (at < REACH + CELLS))
    near = np.lib.stride_tricks.sliding_window_view(weights, 2 * REACH + 1, axis=0)[at[own] - REACH]
    field = np.einsum("tmd,dmn->tn", near, kernel)
    far = block["below"].iloc[0] - before[REACH] + before[at[own] - REACH]
    poly = np.linalg.solve(powers, (field + far[:, None]).T).T
    out = block.iloc[own][["key", "cell"]].copy()
    out["poly"] = list(poly)
    return out


def smooth_ranks(df: DataFrame, key: str, value: str, tau: float, name: str = "rank") -> DataFrame:
    """``df`` with the smooth rank of ``value`` within ``key``, lowest first, as a column ``name``.

    Rows whose value is null or not finite have rank null and count for no other row.
    """
    if tau <= 0:
        raise ValueError("tau must be positive")
    x = F.col(value).cast("double")
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    cell = F.when(fine, F.floor(x / (tau / 2)))
    rows = df.withColumn("__cell", cell).withColumn("__t", (x - (F.col("__cell") + 0.5) * (tau / 2)) / (tau / 4))
    power, sums = F.lit(1.0), []
    for _ in range(TERMS):
        sums.append(F.sum(power))
        power = power * F.col("__t")
    cells = rows.where(F.col("__cell").isNotNull()).groupBy(F.col(key).alias("key"), F.col("__cell").alias("cell"))
    cells = materialise(cells.agg(F.array(*sums).alias("sums")), "cells")
    own = F.floor(F.col("cell") / CELLS)
    totals = cells.groupBy("key", own.alias("b")).agg(F.sum(F.col("sums")[0]).alias("n"))
    w = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("key").alias("k"), "b", F.coalesce(F.sum("n").over(w), F.lit(0.0)).alias("below"))
    around = F.sequence(F.floor((F.col("cell") - REACH) / CELLS), F.floor((F.col("cell") + REACH) / CELLS))
    blocks = cells.withColumn("block", F.explode(around))
    blocks = blocks.join(totals, F.col("key").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b"))).drop("k", "b")
    kind = df.schema[key].dataType.simpleString()
    fields = blocks.groupBy("key", "block").applyInPandas(_fields, f"key {kind}, cell long, poly array<double>")
    fields = materialise(fields.select(F.col("key").alias("__k"), F.col("cell").alias("__c"), "poly"), "fields")
    met = rows.join(fields, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__cell") == F.col("__c")), "left")
    horner = F.aggregate(F.reverse("poly"), F.lit(0.0), lambda acc, a: acc * F.col("__t") + a)
    return met.select(*df.columns, F.when(F.col("poly").isNotNull(), horner + 0.5).alias(name))


def group_spearman(
    df: DataFrame, key: str, a: str, b: str, tau: float = 1.0, eps: float = 1e-8
) -> DataFrame:
    """``key, n, rho``: smooth rank correlation of two columns in groups of any size.

    Rows in which either value is null or not finite are left out of both rankings; a group without
    others has no row. A null key is a group.
    """

    def fine(c: str) -> Column:
        x = F.col(c).cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    rows = df.select(key, a, b).where(fine(a) & fine(b))
    rows = smooth_ranks(smooth_ranks(rows, key, a, tau, "ra"), key, b, tau, "rb")
    n = F.count(F.lit(1))
    root = F.sqrt((n * F.var_pop("ra") + eps) * (n * F.var_pop("rb") + eps))
    return rows.groupBy(key).agg(n.alias("n"), (n * F.covar_pop("ra", "rb") / root).alias("rho"))
