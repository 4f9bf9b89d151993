"""Duplicate suppression without a time limit: a filter in front of a written set of digests.

The digests of all keys ever published are a table, partitioned by prefix. In front of it every batch
leaves one Bloom filter per prefix. A key that no filter knows is new; only the others are looked up, and
only in their prefixes, so what a task holds is one prefix's filters and not the set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epispark.session import scratch_table
from epispark.sources.sinks import stored

BITS_PER_KEY = 16
PROBES = 6  # 16 bits a key, rounded up, and 6 probes: about 1 new key in 1,000 is looked up for nothing


def probes(digests: Sequence[str], slots: int) -> np.ndarray:
    """Bit positions of hexadecimal 128-bit digests in a filter of ``slots`` bits, a power of 2."""
    raw = np.frombuffer(bytes.fromhex("".join(digests)), ">u8").astype(np.uint64).reshape(-1, 2)
    step = raw[:, 1] | np.uint64(1)
    at = raw[:, :1] + np.arange(PROBES, dtype=np.uint64) * step[:, None]
    return (at & np.uint64(slots - 1)).astype(np.int64)


def build_filter(digests: Sequence[str]) -> bytes:
    slots = 1 << max(6, int(BITS_PER_KEY * len(digests) - 1).bit_length())
    bits = np.zeros(slots, bool)
    bits[probes(digests, slots).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, digests: Sequence[str]) -> np.ndarray:
    held = np.frombuffer(bits, np.uint8)
    at = probes(digests, 8 * len(held))
    return (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=1)


def _ask(keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    known = np.zeros(len(keys), bool)
    if len(keys):
        digests = keys["digest"].tolist()
        for bits in filters["bits"]:
            known |= may_hold(bits, digests)
    return keys.loc[known, ["part", "digest"]]


def _filters(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "bits": [build_filter(pdf["digest"].tolist())]})


def replace_parts(df: DataFrame, path: str, *parts: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def drop_repeats_ever(
    stream: DataFrame, keys: Sequence[str], time: str, out: str, seen: str, checkpoint: str, digits: int = 2
) -> None:
    """Append to ``out`` the first row of every key that no earlier batch had, however long ago that was.

    Processes what is available. Of a batch's rows with one key the earliest by ``time`` stays (null first;
    of equal times one of fixed hash order). ``out`` has the stream's columns, partitioned by ``batch``;
    ``seen/digests`` and ``seen/filters`` belong to ``out`` and are partitioned by a prefix of ``digits``
    hexadecimal digits, so that 16 ** digits tasks share them. A null key is a key of its own, an empty
    batch publishes nothing.

    A replayed batch has the same number and replaces what it wrote: marks of its own number do not count.
    Digests are written before the rows, and the rows are what the batch's digests name, so a stop in between
    loses and repeats nothing if the checkpoint stays. A run with a fresh checkpoint and the same ``seen``
    publishes only keys that are new.
    """
    spark = stream.sparkSession
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    digest = F.md5(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))

    def earlier(name: str, like: DataFrame, folder: str) -> DataFrame:
        found = stored(spark, f"{seen}/{name}", like)
        return like.limit(0) if found is None else found.where(F.col("batch") != folder)

    def flush(batch: DataFrame, number: int) -> None:
        folder = f"{run}-{number:09d}"
        row = F.struct(*[F.col(c) for c in batch.columns])
        first = F.min_by(row, F.struct(F.col(time), F.xxhash64(F.to_json(row))))
        firsts = batch.groupBy(digest.alias("digest")).agg(first.alias("row"))
        firsts, drop = scratch_table(firsts.withColumn("part", F.substring("digest", 1, digits)), "arrivals")
        asked = firsts.select("part", "digest")
        shape = spark.createDataFrame([], "bits binary, batch string, part string")
        old = earlier("filters", shape, folder)
        hits = asked.groupBy("part").cogroup(old.groupBy("part")).applyInPandas(_ask, "part string, digest string")
        hits, drop_hits = scratch_table(hits, "maybe-seen")
        parts = [r.part for r in hits.select("part").distinct().collect()]  # 16 ** digits at most
        new = firsts
        if parts:
            shape = spark.createDataFrame([], "digest string, batch string, part string")
            known = earlier("digests", shape, folder).where(F.col("part").isin(parts))
            # the written set streams past the batch's keys
            found = known.join(hits.select("part", "digest"), ["part", "digest"], "left_semi").select("digest")
            new = firsts.join(found, "digest", "left_anti")
        new, drop_new = scratch_table(new, "new-keys")
        marks = new.select("digest", F.lit(folder).alias("batch"), "part")
        if not marks.isEmpty():
            replace_parts(marks.repartition("part").sortWithinPartitions("part", "digest"), f"{seen}/digests", "batch", "part")
            bits = marks.select("part", "digest").groupBy("part").applyInPandas(_filters, "part string, bits binary")
            replace_parts(bits.select("bits", F.lit(folder).alias("batch"), "part"), f"{seen}/filters", "batch")
            replace_parts(new.select("row.*", F.lit(folder).alias("batch")), out, "batch")
        for done in (drop, drop_hits, drop_new):
            done()

    stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
