"""Positional feature store: feature rows bucketed by episode and block, asked by positions.

The stored side of a lookup is never shuffled: the table is bucketed and sorted on the join keys, and
only the requests, a few numbers each, are dealt to its buckets. A block of positions is a key of its
own, so a very long episode is spread over buckets and a lookup reads the blocks it names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.session import scratch_path

BLOCK = 256


def write_store(
    features: DataFrame, name: str, episode: str = "episode_index", position: str = "feat_idx",
    buckets: int | None = None, block: int = BLOCK, path: str | None = None,
) -> str:
    """Saves ``features`` as the bucketed table ``name`` and returns the name; one file per bucket.

    ``path`` is the table's folder, by default one below the shared scratch folder.
    """
    spark = features.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = features.withColumn("block", F.floor(F.col(position) / block).cast("long"))
    (
        rows.repartition(buckets, episode, "block")
        .write.bucketBy(buckets, episode, "block")
        .sortBy(episode, "block", position)
        .option("path", path or scratch_path(spark, "store"))
        .saveAsTable(name)
    )
    return name


def lookup(
    spark: SparkSession, store: str, requests: DataFrame, value: Sequence[str],
    request: str = "request", positions: str = "positions",
    episode: str = "episode_index", position: str = "feat_idx", block: int = BLOCK,
) -> DataFrame:
    """``request``, ``episode``, ``rows`` and ``missing`` for each request of positions of an episode.

    ``rows`` are structs ``at, position, *value`` in the request's own order, a position asked for twice
    comes twice; ``missing`` are the positions, in that order, that the store does not have: negative
    ones, ones beyond the episode, and all of an unknown episode. An empty or null list gives two empty
    arrays. ``requests`` are ``request`` (unique), ``episode`` and the array ``positions``.
    """
    asked = requests.select(request, episode, F.posexplode_outer(positions).alias("at", "wanted"))
    asked = asked.withColumn("__block", F.floor(F.col("wanted") / block).cast("long"))
    stored = spark.table(store).select(F.col(episode).alias("__e"), F.col("block").alias("__b"), F.col(position).alias("__p"), *value)
    # the position is compared, not joined on: keys must be the bucket columns for a join in place
    same = (F.col(episode) == F.col("__e")) & (F.col("__block") == F.col("__b")) & (F.col("wanted") - F.col("__p") == 0)
    met = asked.hint("shuffle_merge").join(stored, same, "left")
    row = F.struct("at", F.col("wanted").alias("position"), *value)
    rows = F.array_sort(F.collect_list(F.when(F.col("__p").isNotNull(), row)))
    gone = F.collect_list(F.when(F.col("__p").isNull() & F.col("at").isNotNull(), F.struct("at", "wanted")))
    return met.groupBy(request, episode).agg(
        rows.alias("rows"), F.transform(F.array_sort(gone), lambda x: x["wanted"]).alias("missing")
    )
