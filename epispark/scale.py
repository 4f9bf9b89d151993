"""Skew-safe building blocks shared by the operators.

An episode normally has a few hundred frames, but nothing here relies on that: every ordered
operation works on ``(episode, block)`` groups of bounded size, so one episode that holds a large
share of all rows is spread over many tasks.

* bounded look-around  -> :class:`Halo` (rows near a block edge are copied into the neighbour);
* unbounded look-back  -> two levels: inside a block, then over one summary row per block;
* exact quantiles      -> a sketch brackets the target ranks, only bracketed rows are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.session import materialise

BLOCK = 4096
ROWS_PER_BUCKET = 1 << 20
ROWS_PER_KEY = 1 << 20
MAX_BUCKETS = 1024


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


class Halo:
    """Row windows ``[-before, +after]`` along a dense index, cut into bounded blocks.

    ``halo.df`` holds each row in its own block plus copies for neighbouring blocks;
    evaluate expressions over ``halo.w`` (ordered) and call :meth:`close` to drop the copies.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        index: str,
        before: int = 0,
        after: int = 0,
        size: int = BLOCK,
    ):
        i = F.col(index)
        first = F.greatest(F.lit(0), F.floor((i - after) / size))
        last = F.floor((i + before) / size)
        self.df = df.withColumn("__block", F.explode(F.sequence(first, last)))
        self.part = [*_cols(keys), F.col("__block")]
        self.w = Window.partitionBy(*self.part).orderBy(i)
        self.all = self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        self._own = F.col("__block") == F.floor(i / size)
        self.index = index

    def rows(self, lo: int, hi: int):
        """Row frame relative to the current row."""
        return self.w.rowsBetween(lo, hi)

    def at(self, col: Column, offset: int, default=None) -> Column:
        """Value ``offset`` rows away, ``default`` (null) outside the episode."""
        if offset == 0:
            return col
        fn = F.lead if offset > 0 else F.lag
        out = fn(col, abs(offset)).over(self.w)
        return out if default is None else F.when(self.inside(offset), out).otherwise(default)

    def inside(self, offset: int) -> Column:
        """True when the row ``offset`` away exists in the episode."""
        if offset <= 0:
            return F.col(self.index) + offset >= 0
        return F.lead(F.lit(True), offset).over(self.w).isNotNull()

    def clamped(self, col: Column, offset: int) -> Column:
        """Value ``offset`` rows away, the episode's first or last row outside it."""
        if offset == 0:
            return col
        edge = F.first(col).over(self.all) if offset < 0 else F.last(col).over(self.all)
        return F.when(self.inside(offset), self.at(col, offset)).otherwise(edge)

    def close(self, df: DataFrame) -> DataFrame:
        return df.where(self._own).drop("__block")


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Sequence[Column],
    name: str = "frame",
) -> DataFrame:
    """0-based row number per key without sorting a whole key in one task.

    ``bucket`` must be a monotone prefix of ``order`` (a day of a timestamp, a quotient of an id):
    rows are numbered inside ``(key, bucket)`` and shifted by the size of the earlier buckets,
    which come from one pre-aggregated summary row per bucket. An empty ``bucket``, for tables that
    :func:`order_buckets` found small, gives the plain one-level window.
    """
    if not bucket:
        w = Window.partitionBy(*_cols(keys)).orderBy(*order)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("long"))
    names = [f"__b{j}" for j in range(len(bucket))]
    rows = df.select("*", *[b.alias(n) for b, n in zip(bucket, names)])
    prior = Window.partitionBy(*_cols(keys)).orderBy(*names)
    offsets = (
        rows.groupBy(*keys, *names)
        .agg(F.count(F.lit(1)).alias("__c"))
        .select(
            *keys,
            *names,
            F.coalesce(
                F.sum("__c").over(prior.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("__shift"),
        )
    )
    inner = Window.partitionBy(*_cols([*keys, *names])).orderBy(*order)
    return (
        rows.join(offsets, [*keys, *names], "left")
        .withColumn(name, F.col("__shift") + F.row_number().over(inner) - 1)
        .select(*df.columns, name)
    )


def order_buckets(
    df: DataFrame, position: Column, rows_per_bucket: int | None = None, keys: Sequence[str] = ()
) -> Column | None:
    """Bucket number of a numeric position, or None when one bucket is enough.

    With ``keys``, one bucket is also enough for a table of any size none of whose keys has more than
    ``ROWS_PER_KEY`` rows: such a key is sorted in one task. Rows are counted by a hash of the key, so
    a few thousand sums bound the longest key from above and no row per key is shuffled.

    A size check like the one before a broadcast: the positions are counted first, and a table of at
    most ``rows_per_bucket`` gets the plain one-level plan. A larger one is cut at approximate
    quantiles of the position, so outliers do not leave most rows in one bucket; only equal positions
    always share one. There are at most ``MAX_BUCKETS``, whose cut points are a literal.
    """
    per = rows_per_bucket or ROWS_PER_BUCKET
    rows = df.agg(F.count(position)).first()[0]
    n = min(-(-rows // per), MAX_BUCKETS)
    if n <= 1:
        return None
    if keys and ROWS_PER_KEY:
        slots = max(4096, 16 * rows // ROWS_PER_KEY)
        held = df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(slots)).alias("slot")).agg(F.count(F.lit(1)).alias("c"))
        if held.agg(F.max("c")).first()[0] <= ROWS_PER_KEY:
            return None
    shares = [i / n for i in range(1, n)]
    cuts = sorted(set(df.agg(F.percentile_approx(position, shares, 10 * n)).first()[0]))
    # the cuts below a position by runs of cuts, then within the run: 2 * 32 of 1,024 comparisons
    run = math.isqrt(len(cuts) - 1) + 1
    runs = F.filter(F.array(*[F.lit(c) for c in cuts[::run]]), lambda c: c < position)
    start = F.greatest(F.size(runs) - 1, F.lit(0)) * run
    near = F.slice(F.array(*[F.lit(c) for c in cuts]), start + 1, run)
    return (start + F.size(F.filter(near, lambda c: c < position))).cast("long")


def key_prefix(bucket: Column | None, *leading: Column) -> list[Column]:
    """Bucket list for a composite order: nothing for a small table, else leading parts first."""
    return [] if bucket is None else [*leading, bucket]


def global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """0-based position of every row in the order of unique columns, whatever their distribution.

    A small table is ranked directly. A large one is range-partitioned and sorted by Spark and
    written once; positions inside a partition are shifted by the sizes of the earlier partitions
    (one summary row each). The written table pins the partitioning, so retries cannot change it.
    """
    if df.limit(ROWS_PER_BUCKET + 1).count() <= ROWS_PER_BUCKET:
        return df.withColumn(
            name, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")
        )
    tagged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__m", F.monotonically_increasing_id())
    )
    stored = materialise(tagged, "ranked").withColumn("__p", F.shiftright("__m", 33))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        stored.groupBy("__p")
        .agg(F.count(F.lit(1)).alias("__c"), F.min("__m").alias("__first"))
        .select(
            "__p", "__first", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__shift")
        )
    )
    return stored.join(shifts, "__p").select(
        *df.columns, (F.col("__m") - F.col("__first") + F.col("__shift")).alias(name)
    )


def in_key_order(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """All rows of a key in one task, sorted by key and ``order``, for a function over the partition.

    Such a function states no distribution. Dealt by the plain keys, the shuffle below an earlier join
    by them would be taken for this one, and adaptive execution may split its partitions or read them
    map by map, as the join allows; a hash of the keys is a shuffle of its own, which is only coalesced.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def explode_range(
    df: DataFrame, lo: Column, hi: Column, name: str, step: int = 1, size: int = BLOCK
) -> DataFrame:
    """One row per number ``lo, lo + step, ...`` below ``hi``.

    Ranges are first cut into blocks of ``size`` numbers and the (few) blocks are spread over the
    cluster, so a very long range neither builds one huge array nor stays in one task.
    """
    lo, hi = lo.cast("long"), hi.cast("long")
    span = size * step
    blocks = df.where(lo < hi).select(
        "*", F.explode(F.sequence(lo, hi - 1, F.lit(span).cast("long"))).alias("__from"),
        hi.alias("__hi"),
    )
    blocks = blocks.repartition(*df.columns, "__from")
    last = F.least(F.col("__from") + (span - 1), F.col("__hi") - 1)
    numbers = F.sequence("__from", last, F.lit(step).cast("long"))
    return blocks.select(*df.columns, F.explode(numbers).alias(name))


def small_side(df: DataFrame, label: str, max_rows: int = 100_000) -> DataFrame:
    """A summary written once and broadcast only when its counted rows stay within ``max_rows``.

    Without the check Spark would shuffle the large side before it learns how small this one is;
    beyond the limit the join stays a shuffle join.
    """
    table = materialise(df, label)
    return F.broadcast(table) if table.count() <= max_rows else table


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Sequence[Column],
    value: Column,
    name: str,
    inclusive: bool = False,
) -> DataFrame:
    """Running sum per key in two levels (inside a bucket, then over bucket totals)."""
    if not bucket:
        w = Window.partitionBy(*_cols(keys)).orderBy(*order)
        w = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))
    names = [f"__b{j}" for j in range(len(bucket))]
    rows = df.select("*", value.alias("__x"), *[b.alias(n) for b, n in zip(bucket, names)])
    prior = Window.partitionBy(*_cols(keys)).orderBy(*names)
    carry = (
        rows.groupBy(*keys, *names)
        .agg(F.sum("__x").alias("__s"))
        .select(
            *keys,
            *names,
            F.coalesce(
                F.sum("__s").over(prior.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("__carry"),
        )
    )
    inner = Window.partitionBy(*_cols([*keys, *names])).orderBy(*order)
    frame = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        rows.join(carry, [*keys, *names], "left")
        .withColumn(name, F.col("__carry") + F.coalesce(F.sum("__x").over(frame), F.lit(0)))
        .select(*df.columns, name)
    )


def fill(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column | None,
    value: Column,
    name: str,
    backward: bool = False,
) -> DataFrame:
    """Latest (or, with ``backward``, next) non-null ``value`` at each row, in two levels.

    Inside a bucket an ordered window answers most rows; the rest take the carry of the nearest
    earlier (later) bucket, which is a window over one row per bucket.
    """
    if bucket is None:
        w = Window.partitionBy(*_cols(keys)).orderBy(*order)
        if backward:
            found = F.first(value, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        else:
            found = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return df.withColumn(name, found)
    rows = df.select("*", value.alias("__x"), bucket.alias("__b0"))
    inner = Window.partitionBy(*_cols([*keys, "__b0"])).orderBy(*order)
    outer = Window.partitionBy(*_cols(keys)).orderBy("__b0")
    if backward:
        near = F.first("__x", True).over(inner.rowsBetween(0, Window.unboundedFollowing))
        edge = F.first("__e", True).over(outer.rowsBetween(1, Window.unboundedFollowing))
        pick = F.min_by
    else:
        near = F.last("__x", True).over(inner.rowsBetween(Window.unboundedPreceding, 0))
        edge = F.last("__e", True).over(outer.rowsBetween(Window.unboundedPreceding, -1))
        pick = F.max_by
    carry = (
        rows.where(F.col("__x").isNotNull())
        .groupBy(*keys, "__b0")
        .agg(pick("__x", F.struct(*order)).alias("__e"))
    )
    buckets = rows.groupBy(*keys, "__b0").agg(F.lit(1).alias("__one"))
    carry = (
        buckets.join(carry, [*keys, "__b0"], "left")
        .select(*keys, "__b0", edge.alias("__carry"))
    )
    return (
        rows.join(carry, [*keys, "__b0"], "left")
        .withColumn(name, F.coalesce(near, "__carry"))
        .select(*df.columns, name)
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: Sequence[float],
    small: int = 20_000,
    accuracy: int = 10_000,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Exact linearly interpolated quantiles: ``keys, n, q array<double>`` plus ``extra``.

    First scan: counts, the ``extra`` aggregates (over ``__v``) and a mergeable sketch, all partially
    aggregated. The sketch brackets every target rank: its rank error is at most ``n / accuracy``
    and the bracket reaches twice as far. Second scan: values below a bracket are only counted, the
    few inside it are counted per distinct value and ranked. Groups of at most ``small`` values take
    all of their values as the bracket. No step holds a whole group.
    """
    if small < 2 * accuracy:
        raise ValueError("small must be at least twice the sketch accuracy")
    keys = list(keys)
    rows = df.select(*keys, value.cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    lows = [max(p - 2.0 / accuracy, 0.0) for p in probs]
    highs = [min(p + 2.0 / accuracy, 1.0) for p in probs]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("__v", lows + highs, accuracy).alias("__cut"),
        *extra,
    )
    m = len(probs)
    sketch = small_side(sketch, "sketch")
    bounds = sketch.select(
        *keys,
        "n",
        *[F.col("__cut")[j].alias(f"__lo{j}") for j in range(m)],
        *[F.col("__cut")[j + m].alias(f"__hi{j}") for j in range(m)],
    )

    def with_bounds(part: DataFrame) -> DataFrame:
        if keys:
            # an outer join keeps the rows on the streamed side; every group has its bounds
            return part.join(bounds, keys, "left")
        names = bounds.columns
        row = part.withColumn("__s", bounds.select(F.struct(*names)).scalar())
        return row.select(*part.columns, "__s.*")

    v, whole = F.col("__v"), F.col("n") <= small
    inside = whole
    for j in range(m):
        inside = inside | ((v >= F.col(f"__lo{j}")) & (v <= F.col(f"__hi{j}")))
    below = [
        F.count_if(~whole & (v < F.col(f"__lo{j}"))).alias(f"__below{j}") for j in range(m)
    ]
    # one hash aggregation: a group per bracketed value, all other values share the null group
    seen = (
        with_bounds(rows)
        .groupBy(*keys, F.when(inside, v).alias("x"))
        .agg(F.count(F.lit(1)).alias("__c"), *below)
    )
    x = F.col("x")
    marks = []
    for j in range(m):
        hit = x.isNotNull() & (whole | ((x >= F.col(f"__lo{j}")) & (x <= F.col(f"__hi{j}"))))
        marks.append(F.when(hit, F.struct(F.lit(j).alias("j"), x.alias("x"), F.col("__c").alias("c"))))
        marks.append(
            F.when(
                F.col(f"__below{j}") > 0,
                F.struct(
                    F.lit(j).alias("j"),
                    F.lit(None).cast("double").alias("x"),
                    F.col(f"__below{j}").alias("c"),
                ),
            )
        )
    counts = (
        with_bounds(seen)
        .select(*keys, "n", F.inline(F.array_compact(F.array(*marks))))
        .groupBy(*keys, "n", "j", "x")
        .agg(F.sum("c").alias("c"))
    )
    w = Window.partitionBy(*_cols([*keys, "j"])).orderBy(F.col("x").asc_nulls_first())
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probs]), F.col("j") + 1)
    ranked = counts.withColumns(
        {
            "upto": F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "pos": (F.col("n") - 1) * p,
        }
    )

    def order_stat(rank: Column) -> Column:
        hit = (
            F.col("x").isNotNull()
            & (F.col("upto") > rank)
            & (F.col("upto") - F.col("c") <= rank)
        )
        return F.max(F.when(hit, F.col("x")))

    k = F.floor("pos")
    picked = (
        ranked.groupBy(*keys, "n", "j", "pos")
        .agg(
            order_stat(k).alias("a"),
            order_stat(F.least(k + 1, F.col("n") - 1)).alias("b"),
        )
        .select(*keys, "n", "j", F.expr("a + (b - a) * (pos - floor(pos))").alias("y"))
    )
    out = picked.groupBy(*keys, "n").agg(
        F.array_sort(F.collect_list(F.struct("j", "y"))).alias("s")
    )
    out = out.select(*keys, "n", F.col("s.y").alias("q"))
    if not extra:
        return out
    if not keys:
        raise ValueError("extra aggregates need at least one key")
    return out.join(sketch.drop("n", "__cut"), keys)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    width: int = BLOCK,
) -> DataFrame:
    """Rows of ``points`` whose ``at`` lies in ``[start, end)`` of an interval, as an equi-join.

    Both sides get a bucket ``floor(position / width)``; an interval is copied to each bucket it
    touches, a point lives in exactly one, so no pair appears twice and no theta join is planned.
    """
    p = points.withColumn("__bucket", F.floor(F.col(at) / width))
    last = F.greatest(F.col(start), F.col(end) - 1)
    s = intervals.where(F.col(start) < F.col(end)).withColumn(
        "__bucket",
        F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))),
    )
    return (
        p.join(s, [*keys, "__bucket"])
        .where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))
        .drop("__bucket")
    )
