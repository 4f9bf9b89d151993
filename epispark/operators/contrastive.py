"""Contrastive score of batches that are larger than a task.

Every row's logits are needed against every column of its batch. Rows are dealt into slots, a group of
plain rows holds one slot of students and one of teachers, and answers with a maximum and a sum of
exponentials per row and per column; these merge in any order. The similarity matrix is never stored or
sent, and only ``tile`` of its rows exist at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 512
SLOT = 4096  # rows of a slot at most; a row is sent once per slot of its batch and side
SLOTS = 16  # slots of a batch whose slots would be smaller than that


def _merged(parts: Column) -> Column:
    """Log of the sum of exponentials from (top, total) pairs, ``total`` relative to ``top``."""
    top = F.array_max(F.transform(parts, lambda p: p["top"]))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + p["total"] * F.exp(p["top"] - top))
    return top + F.log(total)


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    v = vectors.combine_chunks()
    width = np.unique(np.diff(v.offsets.to_numpy()))
    if len(width) > 1:
        raise ValueError("vectors of a batch differ in width")
    x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def paired_slots(
    df: DataFrame, batch: str, order: str, student: str, teacher: str, tile: int = TILE
) -> DataFrame:
    """``batch, i, j, side, row, v``: a row of side 0 stands in slot i against every j, of side 1 the other way."""
    rows = df.where(F.col(student).isNotNull() & F.col(teacher).isNotNull()).select(batch, order, student, teacher)
    n = F.count(F.lit(1))
    per = F.greatest(F.lit(tile), F.least(F.lit(SLOT), F.ceil(n / SLOTS)))
    sizes = rows.groupBy(F.col(batch).alias("__b")).agg(F.ceil(n / per).cast("int").alias("slots"))
    rows = rows.join(sizes, F.col(batch).eqNullSafe(F.col("__b"))).withColumn("slot", F.pmod(F.xxhash64(order), "slots"))

    def side(number: int, vector: str) -> DataFrame:
        other = F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("against")
        held = rows.select(F.col(batch).alias("batch"), "slot", other, F.col(order).alias("row"), F.col(vector).alias("v"))
        i, j = ("slot", "against") if number == 0 else ("against", "slot")
        return held.select("batch", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(number).alias("side"), "row", "v")

    return side(0, student).unionByName(side(1, teacher))


def tiled_info_nce(
    df: DataFrame, batch: str, order: str, student: str, teacher: str, temperature: float = 0.07, tile: int = TILE
) -> DataFrame:
    """``batch, n, loss``: symmetric contrastive score per batch of any number of rows.

    ``order`` names a row within its batch. Rows with a null vector are left out; a batch of one row
    has loss 0; a null batch is a batch.
    """
    slots = paired_slots(df, batch, order, student, teacher, tile)

    def score(held: pa.Table) -> pa.Table:
        kept = [held.schema.field(x) for x in ("batch", "side", "row")]
        parts = pa.schema([*kept, *[pa.field(x, pa.float64()) for x in ("top", "total", "own")]])
        side = held["side"].to_numpy()
        at = [np.flatnonzero(side == k) for k in (0, 1)]
        if not len(at[0]) or not len(at[1]):
            return parts.empty_table()
        s, t = (_units(held["v"].take(pa.array(a))) for a in at)
        names = [held["row"].take(pa.array(a)).to_pylist() for a in at]
        place = {x: j for j, x in enumerate(names[1])}
        top, total = np.full(len(side), -np.inf), np.zeros(len(side))
        own = np.full(len(side), np.nan)
        high, mass = np.full(len(t), -np.inf), np.zeros(len(t))
        for lo in range(0, len(s), tile):
            m = s[lo : lo + tile] @ t.T / temperature
            mine, best = at[0][lo : lo + tile], m.max(axis=1)
            top[mine], total[mine] = best, np.exp(m - best[:, None]).sum(axis=1)
            for i, x in enumerate(names[0][lo : lo + tile]):
                if x in place:
                    own[mine[i]] = m[i, place[x]]
            new = np.maximum(high, m.max(axis=0))
            mass = mass * np.exp(high - new) + np.exp(m - new).sum(axis=0)
            high = new
        top[at[1]], total[at[1]] = high, mass
        return pa.table([held["batch"], held["side"], held["row"], top, total, own], schema=parts)

    types = [slots.schema[x].dataType.simpleString() for x in ("batch", "row")]
    merged = slots.groupBy("batch", "i", "j").applyInArrow(
        score, f"batch {types[0]}, side int, row {types[1]}, top double, total double, own double"
    )
    own = F.sum(F.when(~F.isnan("own"), F.col("own")))
    per_row = merged.groupBy("batch", "side", "row").agg(
        _merged(F.collect_list(F.struct("top", "total"))).alias("lse"), own.alias("own")
    )
    total = F.sum("lse") - 2 * F.coalesce(F.sum("own"), F.lit(0.0))  # both sides subtract the same diagonal
    n = F.count(F.when(F.col("side") == 0, True))
    return per_row.groupBy(F.col("batch").alias(batch)).agg(n.alias("n"), (total / (2 * n)).alias("loss"))
