"""Weighted mixtures and reproducible draws.

Every draw is a hash of its seed and key (:func:`hash_uniform`), so a rerun or a retried task gives
the same sample on any cluster. Mixture tables have one row per dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epispark.functions.ids import hash_uniform
from epispark.scale import interval_join, prefix_sum, small_side


def normalise_weights(mixture: DataFrame, weight: str = "weight") -> DataFrame:
    """Weights divided by their sum; negative weights or a zero sum are errors."""
    total = mixture.agg(F.sum(weight).alias("t")).scalar()
    w = F.col(weight)
    out = (
        F.when(w < 0, F.raise_error(F.lit("weights must be non-negative")).cast("double"))
        .when(total <= 0, F.raise_error(F.lit("weights sum to zero")).cast("double"))
        .otherwise(w / total)
    )
    return mixture.withColumn(weight, out)


def filter_mixture(mixture: DataFrame, names: Sequence[str], name: str = "name") -> DataFrame:
    """Entries of the given names, renormalised."""
    return normalise_weights(mixture.where(F.col(name).isin(*names)))


def mixture_summary(mixture: DataFrame, sizes: DataFrame, name: str = "name") -> DataFrame:
    """Normalised weight and number of items per source."""
    return normalise_weights(mixture).join(sizes, name, "left").select(name, "weight", "items")


def dataset_weights(
    mixture: DataFrame, balance: bool = False, weight: str = "weight", length: str = "length"
) -> DataFrame:
    """Sampling weights, optionally times the dataset length, floored at 1e-8 when any of them is
    not positive; an undefined sum gives equal weights."""
    w = F.col(weight) * F.col(length) if balance else F.col(weight).cast("double")
    rows = mixture.withColumn("__w", w)
    facts = rows.agg(
        F.struct(
            F.coalesce(F.bool_or(F.col("__w") <= 0), F.lit(False)).alias("low"),
            F.sum(F.greatest("__w", F.lit(1e-8))).alias("floored"),
            F.sum("__w").alias("plain"),
            F.count(F.lit(1)).alias("n"),
        )
    ).scalar()
    rows = rows.withColumn("__f", facts)
    value = F.when(F.col("__f.low"), F.greatest("__w", F.lit(1e-8))).otherwise(F.col("__w"))
    total = F.when(F.col("__f.low"), F.col("__f.floored")).otherwise(F.col("__f.plain"))
    bad = total.isNull() | F.isnan(total) | (total == 0)
    equal = F.lit(1.0) / F.col("__f.n")
    out = F.when(bad, equal).otherwise(value / total)
    return rows.withColumn("sampling_weight", out).drop("__w", "__f")


def trajectory_weights(
    episodes: DataFrame, dataset: str, length: str, balance: bool = True
) -> DataFrame:
    """Weight of each trajectory inside its dataset, by length or equal.

    The dataset totals are one pre-aggregated row each and are joined back.
    """
    w = F.greatest(F.col(length).cast("double"), F.lit(1e-8)) if balance else F.lit(1.0)
    rows = episodes.withColumn("__w", w)
    totals = small_side(rows.groupBy(dataset).agg(F.sum("__w").alias("__t")), "totals")
    return (
        rows.join(totals, dataset, "left")
        .withColumn("trajectory_weight", F.col("__w") / F.col("__t"))
        .drop("__w", "__t")
    )


def primary_datasets(mixture: DataFrame, weight: str = "weight") -> DataFrame:
    """Flag the datasets of weight 1, or those of the highest weight when there is none."""
    facts = mixture.agg(
        F.struct(
            F.bool_or(F.col(weight) == 1.0).alias("one"), F.max(weight).alias("top")
        )
    ).scalar()
    rows = mixture.withColumn("__f", facts)
    flag = F.when(F.col("__f.one"), F.col(weight) == 1.0).otherwise(
        F.col(weight) == F.col("__f.top")
    )
    return rows.withColumn("is_primary", flag).drop("__f")


def epoch_length(
    weighted: DataFrame, length: str = "length", weight: str = "sampling_weight"
) -> DataFrame:
    """Whole part of the largest length/weight over the primary datasets; without a usable primary
    dataset the largest length."""
    ok = (F.col(length) > 0) & (F.col(weight) > 0)
    ratio = F.max(F.when(F.col("is_primary") & ok, F.col(length) / F.col(weight)))
    fallback = F.max(F.when(ok, F.col(length)))
    return weighted.agg(
        F.coalesce(F.floor(ratio), fallback.cast("long"), F.lit(0)).alias("epoch_length")
    )


def cumulative_choices(items: DataFrame, name: str, weight: str) -> DataFrame:
    """One row: ``choices array<struct<upto, name>>`` of a small weighted list in name order."""
    w = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    rows = items.withColumn("__u", F.sum(weight).over(w))
    item = F.struct(F.col("__u").alias("upto"), F.col(name).alias("name"))
    return rows.agg(F.array_sort(F.collect_list(item)).alias("choices"))


def pick(choices: Column, u: Column) -> Column:
    """First choice whose cumulative weight exceeds ``u`` (the last one on rounding)."""
    # binding u as the variable of an outer transform evaluates the draw once per row
    hit = F.transform(
        F.array(u), lambda x: F.get(F.filter(choices, lambda c: c["upto"] > x), F.lit(0))
    )
    return F.coalesce(F.get(hit, F.lit(0)), F.try_element_at(choices, F.lit(-1)))["name"]


def draws(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "draw")


def draw_items(
    slots: DataFrame, mixture: DataFrame, slot: str, seed: int, name: str = "name",
    weight: str = "weight", size: str = "items",
) -> DataFrame:
    """For each slot a source by weight and a uniform item of it (with replacement).

    Item weight is source weight over source size, so a source is drawn first from the mixture's
    cumulative weights and then a position below its size.
    """
    choices = cumulative_choices(normalise_weights(mixture, weight), name, weight)
    u = hash_uniform(F.lit(seed), F.col(slot), F.lit("source"))
    v = hash_uniform(F.lit(seed), F.col(slot), F.lit("item"))
    rows = slots.withColumn("__c", choices.scalar()).withColumn(name, pick(F.col("__c"), u))
    return (
        rows.drop("__c")
        .join(mixture.select(name, size), name)
        .withColumn("item", F.floor(v * F.col(size)))
        .drop(size)
    )


def draw_steps(
    slots: DataFrame, episodes: DataFrame, slot: str, dataset: str, episode: str, length: str,
    seed: int, width: int = 1 << 16,
) -> DataFrame:
    """For each slot (with its dataset) a uniform step over all of the dataset's trajectories.

    Trajectories get consecutive step ranges; the drawn step number meets its range through a
    bucketed equi-join, so neither side is broadcast or collected.
    """
    bucket = F.floor(F.col(episode) / 4096)
    ranges = prefix_sum(episodes, [dataset], [episode], [bucket], F.col(length), "start")
    ranges = ranges.withColumn("end", F.col("start") + F.col(length))
    totals = small_side(episodes.groupBy(dataset).agg(F.sum(length).alias("__t")), "totals")
    u = hash_uniform(F.lit(seed), F.col(slot), F.lit("step"))
    points = slots.join(totals, dataset).withColumn("at", F.floor(u * F.col("__t")))
    hit = interval_join(
        points, ranges.select(dataset, episode, "start", "end"), [dataset], "at", "start", "end",
        width,
    )
    return hit.withColumn("step", F.col("at") - F.col("start")).drop("__t", "at", "start", "end")


def task_batches(
    spark: SparkSession, n_batches: int, batch_size: int, weights: dict[str, float], seed: int,
    epoch: int = 0, rank: int = 0, replicas: int = 1,
) -> DataFrame:
    """Batches in which every task occurs at least once and the rest follows the task weights.

    Each row has the batch, a shuffled slot, the task and the task's own index stream
    (``rank, rank + replicas, ...``), numbered in two levels over batches.
    """
    return task_batches_for(
        spark.range(n_batches).select(F.col("id").alias("batch")),
        batch_size, weights, seed, epoch, rank, replicas,
    )


def task_batches_for(
    batches: DataFrame, batch_size: int, weights: dict[str, float], seed: int, epoch: int = 0,
    rank: int = 0, replicas: int = 1,
) -> DataFrame:
    """:func:`task_batches` for a given table of ``batch`` numbers."""
    tasks = list(weights)
    if batch_size < len(tasks):
        raise ValueError("batch_size must be at least the number of tasks")
    total = sum(weights.values())
    upto, run = [], 0.0
    for t in tasks:
        run += weights[t] / total
        upto.append(run)
    slots = batches.select(
        "batch", F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))).alias("slot")
    )
    u = hash_uniform(F.lit(seed), F.lit(epoch), F.lit(rank), F.col("batch"), F.col("slot"))
    drawn = F.lit(tasks[-1])
    for t, limit in reversed(list(zip(tasks[:-1], upto[:-1]))):
        drawn = F.when(u < limit, F.lit(t)).otherwise(drawn)
    fixed = F.get(F.array(*[F.lit(t) for t in tasks]), F.col("slot"))
    rows = slots.withColumn("task", F.when(F.col("slot") < len(tasks), fixed).otherwise(drawn))
    bucket = F.floor(F.col("batch") / 1024)
    rows = prefix_sum(rows, ["task"], ["batch", "slot"], [bucket], F.lit(1), "__k")
    rows = rows.withColumn("index", F.col("__k") * replicas + rank)
    order = hash_uniform(
        F.lit(seed), F.lit(epoch), F.lit(rank), F.col("batch"), F.col("slot"), F.lit("order")
    )
    w = Window.partitionBy("batch").orderBy(order, "slot")
    return rows.select(
        "batch", (F.row_number().over(w) - 1).alias("position"), "task", "index"
    )


def parse_rate(name: Column) -> tuple[Column, Column]:
    """Name without its ``%NN`` suffix and the sampling rate it states (1 without one)."""
    digits = F.regexp_extract(name, r"%(\d+)$", 1)
    rate = F.when(digits != "", digits.try_cast("int") / 100.0).otherwise(F.lit(1.0))
    return F.regexp_replace(name, r"%(\d+)$", ""), rate


def sample_rate(
    df: DataFrame, dataset: str, item: str, rates: DataFrame, seed: int, buckets: int = 4096
) -> DataFrame:
    """Exactly ``floor(rate * n)`` rows of each dataset, by hash order.

    The hash order is cut into equal hash ranges: whole ranges are taken or left by their counts and
    only the range at the border is ranked, so a large dataset never sits in one sort.
    """
    u = hash_uniform(F.lit(seed), F.col(dataset), F.col(item))
    rows = df.withColumn("__u", u).withColumn("__b", F.floor(F.col("__u") * buckets))
    w = Window.partitionBy(dataset).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(dataset, "__b").agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    sizes = counts.groupBy(dataset).agg(F.sum("__c").alias("__n"))
    k = F.floor(F.round(F.col("rate") * F.col("__n"), 6))
    limits = counts.join(sizes, dataset).join(rates, dataset).withColumn("__k", k)
    limits = limits.where(F.col("__before") < F.col("__k"))
    inner = Window.partitionBy(dataset, "__b").orderBy("__u", item)
    return (
        rows.join(limits.select(dataset, "__b", "__before", "__k"), [dataset, "__b"])
        .withColumn("__r", F.row_number().over(inner))
        .where(F.col("__before") + F.col("__r") <= F.col("__k"))
        .select(*df.columns)
    )


def hold_out(samples: DataFrame, item: str, n: int, seed: int) -> DataFrame:
    """``n`` samples by hash order without replacement when there are enough of them."""
    u = hash_uniform(F.lit(seed), F.col(item))
    return samples.orderBy(u, item).limit(n)


def hold_out_with_replacement(samples: DataFrame, index: str, n: int, seed: int) -> DataFrame:
    """``n`` draws by dense sample index, for data sets smaller than ``n``."""
    total = samples.agg(F.count(F.lit(1)).alias("n")).scalar()
    slots = draws(samples.sparkSession, n)
    u = hash_uniform(F.lit(seed), F.col("draw"))
    return slots.withColumn(index, F.floor(u * total)).join(samples, index)


def round_robin(df: DataFrame, position: str, rank: int, world: int) -> DataFrame:
    """Every ``world``-th row from ``rank`` on, by a dense position."""
    return df.where(F.col(position) % world == rank)


def step_for_draw(draw: Column, rank: Column, world: Column, n_steps: Column) -> Column:
    """Step position of a worker's ``draw``-th sample; a used-up shard starts over."""
    shard = F.floor((n_steps - rank + world - 1) / world)
    return (draw % F.greatest(shard, F.lit(1))) * world + rank


def per_tag_sample(
    datasets: DataFrame, tag: str, item: str, k: int, seed: int
) -> DataFrame:
    """Up to ``k`` items per tag by hash order (the rank filter is applied before the shuffle)."""
    u = hash_uniform(F.lit(seed), F.col(tag), F.col(item))
    w = Window.partitionBy(tag).orderBy("__u", item)
    return (
        datasets.withColumn("__u", u)
        .withColumn("__r", F.row_number().over(w))
        .where(F.col("__r") <= k)
        .drop("__u", "__r")
    )
