"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.session import scratch_table


def _star(edges: DataFrame, small: bool, drops: list[Callable[[], None]]) -> DataFrame:
    """One star operation on edges ``a > b``; hubs are aggregated map-side, never gathered."""
    if small:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        near = edges.select(
            F.inline(
                F.array(
                    F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                    F.struct(F.col("b").alias("u"), F.col("a").alias("v")),
                )
            )
        )
    low = near.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    low, drop = scratch_table(low, "lowest")  # so that adaptive execution can split a hub's rows in the join
    drops.append(drop)
    joined = near.join(low, F.col("u") == F.col("w"))
    if small:
        moved = joined.select(
            F.inline(
                F.array(
                    F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                    F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
                )
            )
        )
    else:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.where("a > b").distinct()


def components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node with a link, ``root`` the smallest node it reaches.

    Links are long columns in any direction, repeats and self-links allowed; rows with a null end are
    left out. Each round writes its edges to the shared folder, so lineage stays short, and deletes those
    of the round before; the loop ends when a round changes nothing. Only counts and sums come to the driver.
    """
    a, b = F.col(left), F.col(right)
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), a.isNotNull().alias("x"), b.isNotNull().alias("y"))
    edges, drop = scratch_table(edges.where("x AND y AND a > b").select("a", "b").distinct(), "edges")
    state = None
    for _ in range(rounds):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = now
        drops = [drop]
        edges, drop = scratch_table(_star(_star(edges, False, drops), True, drops), "edges")
        for done in drops:
            done()
    raise RuntimeError(f"components did not settle in {rounds} rounds")
