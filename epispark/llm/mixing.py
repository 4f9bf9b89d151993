"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.llm.words import free_names, numbered
from epispark.session import materialise

#: (time, weight) knots, linear in between, over training time 0..1. The integrals are 3, 1 and 2.
SCHEDULES = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 2.0), (1.0, 2.0)))
#: Leading hex digits of the order hash: a source is cut into 16 ** DIGITS parts for prefix sums.
DIGITS = 3


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))


def invert(knots: Sequence[tuple[float, float]], share: Column) -> Column:
    """Time at which the schedule has demanded ``share`` (0..1) of its integral."""
    total, done, out = integral(knots), 0.0, F.lit(float(knots[-1][0]))
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        h, area = t1 - t0, (t1 - t0) * (w0 + w1) / 2
        need = F.greatest(share * total - done, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit((h * w0) ** 2) + 2 * h * h * (w1 - w0) * need / h, F.lit(0.0)))
        below = h * w0 + root
        step = F.when(below > 0, 2 * need / below).otherwise(0.0)
        done += area
        pieces.append((done, t0 + h * F.least(step, F.lit(1.0))))
    for done, time in reversed(pieces):
        out = F.when(share * total <= done, time).otherwise(out)
    return out


def targets(
    totals: DataFrame, schedules: Sequence = SCHEDULES, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Target words of every source from its size; one row per source.

    Sources in code-point order, null last, take the schedules in turn. A source's weight is the
    integral of its schedule. ``share`` of all words is dealt by weight; no source gets over ``cap``
    times its size, and the excess goes to the others by weight until none is above. That level is
    the largest of ``(total - caps below) / weights left`` over the sources in order of cap / weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weights = F.array(*[F.lit(integral(s)) for s in schedules])
    ranked = totals.withColumn("turn", ((F.row_number().over(by_name) - 1) % len(schedules)))
    ranked = ranked.withColumn("weight", weights[F.col("turn")])
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "source").rowsBetween
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(by_ratio(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    ranked = ranked.withColumn("level", (total - capped * F.lit(float(cap))) / left)
    level = F.max("level").over(everything)
    target = F.least(F.col("source_size") * F.lit(float(cap)), F.col("weight") * level)
    return ranked.select("source", "turn", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    source: str = "source",
    key: str = "doc_id",
    schedules: Sequence = SCHEDULES,
    share: float = 1.5,
    cap: float = 2.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per document: ``key, source, size, source_size, target, taken, positions, position``.

    Columns named in ``carry`` come along, and decide between rows of equal key and size.

    Inside a source documents follow one another in the order of ``md5(key)``, again from the start
    after the last one, until the target is reached: ``taken`` words come from a document, at most
    ``cap`` times its size, and a source's sum is the whole part of its target. ``positions`` are the
    times (0..1) at which the source's cumulative demand, the integral of its schedule, reaches each
    of the document's copies; ``position`` is the first one, null where nothing is taken. Rows come
    out range-sorted by position, untaken ones last.

    Sizes are computed once into a written table. Prefix sums go by (source, leading hash digits),
    so a source with a third of all rows is spread over 16 ** DIGITS groups; only the summary per
    group crosses them. Reruns agree.

    Null keys count as the empty text in the hash; null sources form one source; repeated rows are
    rows of their own; empty texts have size 0 and take 0; an empty table gives an empty table.
    """
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    sized = materialise(
        docs.select(
            F.col(key).alias("doc_id"),
            F.col(source).alias("source"),
            size.cast("long").alias("size"),
            hashed.alias("h"),
            *carry,
        ),
        "mix-sizes",
    ).withColumn("part", F.substring("h", 1, DIGITS))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    goal = targets(
        parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), schedules, share, cap
    )
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("shift", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    parts = parts.alias("p").join(goal.alias("g"), F.expr("p.source <=> g.source")).select(
        F.col("p.source").alias("p_source"), F.col("part").alias("p_part"),
        "shift", "turn", "source_size", "target",
    )
    inner = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size", *carry)
    rows = sized.withColumn(
        "inside",
        F.coalesce(F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).join(parts, F.expr("source <=> p_source AND part = p_part"))
    start = F.col("shift") + F.col("inside")
    whole = F.floor("target")
    epochs = range(math.ceil(cap))
    begins = [start + e * F.col("source_size") for e in epochs]
    amounts = [F.greatest(F.lit(0), F.least(F.col("size"), whole - b)) for b in begins]
    times = []
    for b, amount in zip(begins, amounts):
        reached = F.when(F.col("target") > 0, b / F.col("target")).otherwise(0.0)
        time = F.lit(None).cast("double")
        for turn, knots in enumerate(schedules):
            time = F.when(F.col("turn") == turn, invert(knots, reached)).otherwise(time)
        times.append(F.when(amount > 0, time))
    rows = rows.select(
        F.col("doc_id").alias(key), F.col("source").alias(source), "size", "source_size", "target",
        sum(amounts[1:], amounts[0]).cast("long").alias("taken"),
        F.array_compact(F.array(*times)).alias("positions"), "h", *carry,
    ).withColumn("position", F.get("positions", F.lit(0)))
    order = [F.col("position").asc_nulls_last(), F.col("h")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("h")


def draw(
    docs: DataFrame, size: Column, source: str = "source", key: str = "doc_id", **how
) -> DataFrame:
    """The mixed training stream: the columns of ``docs``, a row for each copy, range-sorted.

    A copy that the target cuts is taken whole, since documents are never truncated, if at least half
    of it fits. Positions are times in 0..1, so partitions are equal slices of training time and need
    no sampling job. Rows are planned by number, so repeated and null keys are rows like any other.
    """
    k, at, row = free_names(docs, "mix_key", "mix_time", "mix_row")
    docs = numbered(docs, row)
    plan = mix(docs, size, source, key, carry=(row,), **how).where(F.col("taken") > 0)
    copies = plan.select(F.col(row).alias(k), F.posexplode("positions").alias("n", at), "size", "taken")
    copies = copies.where(F.col("taken") - F.col("n") * F.col("size") >= F.col("size") / 2)
    rows = docs.join(copies.select(k, at), F.col(row) == F.col(k))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.least(F.floor(F.col(at) * parts), F.lit(parts - 1)).cast("int")
    return rows.repartitionById(parts, place).sortWithinPartitions(at, k).drop(k, at, row)
