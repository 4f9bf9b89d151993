"""Alias tables for mixtures with very many sources: a draw is one look at one slot.

Each of ``n`` sources has a slot of equal size. Sources that are lighter than a slot leave room, heavier
ones give their excess to it, in the order of two running sums; so the whole table follows from prefix
sums and interval joins, with no step that goes from source to source. Shares are integers, so the
table is exact for them and the same on every run and engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.functions.ids import hash_uniform
from epispark.scale import global_rank, interval_join, prefix_sum
from epispark.session import materialise

RESOLUTION = 1 << 36  # weights are shares of this; up to 2 ** 26 sources keep sums in a long
BUCKET = 1 << 16


def alias_table(mixture: DataFrame, name: str = "name", weight: str = "weight") -> DataFrame:
    """``slot, name, alias, keep, room``: a draw of a slot is ``name`` with chance ``keep / room``.

    Null and negative weights count as 0, names must be unique; a mixture whose weights are all 0 has
    no table (no rows), as has an empty one.
    """
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = mixture.select(F.col(name).alias("name"), w.alias("w"))
    total, n = rows.agg(F.sum("w"), F.count(F.lit(1))).first()
    if not total:
        return mixture.sparkSession.createDataFrame([], f"slot long, name {mixture.schema[name].dataType.simpleString()}, alias {mixture.schema[name].dataType.simpleString()}, keep long, room long")
    if n > RESOLUTION >> 10:
        raise ValueError(f"{n} sources are too many for shares of 2 ** -36")
    share = F.floor(F.col("w") / F.lit(total) * F.lit(float(RESOLUTION))).cast("long")
    rows = materialise(global_rank(rows.withColumn("share", share), ["name"], "slot"), "alias-shares")
    room = rows.agg(F.sum("share")).first()[0]
    rows = rows.select("slot", "name", (F.col("share") * n).alias("mass"))
    bucket = [F.floor(F.col("slot") / BUCKET)]
    gap = F.abs(F.col("mass") - room)
    light = prefix_sum(rows.where(F.col("mass") < room), [], ["slot"], bucket, gap, "upto", True)
    light = materialise(light.withColumn("from", F.col("upto") - (room - F.col("mass"))), "alias-light")
    heavy = prefix_sum(rows.where(F.col("mass") >= room), [], ["slot"], bucket, gap, "upto", True)
    heavy = materialise(global_rank(heavy, ["slot"], "turn").withColumn("from", F.col("upto") - (F.col("mass") - room)), "alias-heavy")
    width = max(1, room * n // max(n, 1))
    # a light slot is filled by the heavy source whose excess covers where its need begins
    filled = interval_join(
        light.select("slot", "name", "mass", F.col("from").alias("need")),
        heavy.select(F.col("name").alias("alias"), F.col("from").alias("lo"), F.col("upto").alias("hi")), [], "need", "lo", "hi", width,
    ).select("slot", "name", "alias", F.col("mass").alias("keep"))
    # a heavy source used up inside a need lacks the rest of it, which its successor fills
    ends = light.select((F.col("from") + 1).alias("lo"), (F.col("upto") + 1).alias("hi"), F.col("upto").alias("need_end"))
    over = interval_join(heavy.select("slot", "upto"), ends, [], "upto", "lo", "hi", width).select(
        F.col("slot").alias("s"), (F.col("need_end") - F.col("upto")).alias("over")
    )
    after = heavy.select((F.col("turn") - 1).alias("t"), F.col("name").alias("next"))
    used = heavy.join(over, F.col("slot") == F.col("s"), "left").join(after, F.col("turn") == F.col("t"), "left")
    used = used.select("slot", "name", F.coalesce("next", "name").alias("alias"), (room - F.coalesce("over", F.lit(0))).alias("keep"))
    return filled.unionByName(used).select("slot", "name", "alias", F.col("keep").cast("long").alias("keep"), F.lit(room).cast("long").alias("room"))


def alias_draws(draws: DataFrame, table: DataFrame, draw: str, seed: int) -> DataFrame:
    """``draws`` with the drawn ``name``; one slot join per draw, the same on a rerun.

    ``table`` is a written :func:`alias_table`.
    """
    n = table.count()
    u = hash_uniform(F.lit(seed), F.col(draw), F.lit("slot"))
    v = hash_uniform(F.lit(seed), F.col(draw), F.lit("side"))
    rows = draws.withColumn("__s", F.floor(u * n)).withColumn("__v", v)
    met = rows.join(table, F.col("__s") == F.col("slot"))
    side = F.when(F.floor(F.col("__v") * F.col("room")) < F.col("keep"), F.col("name")).otherwise(F.col("alias"))
    return met.select(*draws.columns, side.alias("name"))
