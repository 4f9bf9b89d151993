"""MinHash near-duplicates by one-permutation hashing.

One hash per shingle: its leading bits name a bin, and a bin keeps its smallest hash. Empty bins take
the value of the first non-empty bin on a way of their own (optimal densification), so short texts
keep unbiased signatures. Bands of bins are buckets, and buckets are linked by stars.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.linking import similar_components
from epispark.llm.shingle_simhash import shingle_sets
from epispark.llm.wordhash import U, mix, shingles, word_hashes
from epispark.llm.words import free_names, numbered, text_batches
from epispark.session import materialise, scratch_table

BITS = 7  # 128 bins
ROWS = 4  # bins in a band: a pair of similarity 0.8 misses all 32 bands with chance 5e-8


@functools.lru_cache(maxsize=2)
def _ways(bits: int) -> np.ndarray:
    """For each bin the order in which it asks the others for a value."""
    rng = np.random.default_rng(13)
    return np.array([rng.permutation(1 << bits) for _ in range(1 << bits)])


def signature(hashes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One value per bin of a non-empty sorted set of 64-bit hashes."""
    bins = np.arange(1 << bits, dtype=U)
    at = np.minimum(np.searchsorted(hashes, bins << U(64 - bits)), len(hashes) - 1)
    out = hashes[at]
    full = out >> U(64 - bits) == bins
    empty = np.flatnonzero(~full)
    if len(empty):
        ways = _ways(bits)[empty]
        pick = full[ways].argmax(axis=1)
        out[empty] = out[ways[np.arange(len(empty)), pick]]
    return out


def band_keys(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = values.reshape(-1, rows)
    key = np.arange(len(bands), dtype=U) + U(1)
    for j in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + bands[:, j])
    return key


def _bands(width: int, bits: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "key", "n", "d1", "d2", "bands"]
        for batch in batches:
            n, d, keys = [], [], []
            for text in batch.column(2):
                words, _, _ = word_hashes(text.as_py() or b"", lower=True)
                own = np.unique(shingles(words, width))
                n.append(len(own))
                d.append(np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64))
                keys.append(band_keys(signature(own, bits), rows) if len(own) else own)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            d = np.array(d, np.int64).reshape(-1, 2)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), bands], names=names
            )

    return run


def banded(src: DataFrame, width: int, bits: int = BITS, rows: int = ROWS) -> DataFrame:
    """``row, key, n, d1, d2, bands`` of every document (``row, key, text``): the size of its set of distinct
    shingle hashes, the set's 128-bit digest, and its band keys."""
    text_batches(src.sparkSession)
    src = src.select("row", "key", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")]
    bands = T.StructField("bands", T.ArrayType(T.LongType()))
    return src.mapInArrow(_bands(width, bits, rows), T.StructType([*src.schema.fields[:2], *longs, bands]))


def band_members(reps: DataFrame) -> DataFrame:
    """``key, cid, n`` of all members of band buckets with two classes or more."""
    rows, drop = scratch_table(reps.select(F.explode("bands").alias("key"), "cid", "n"), "bands")
    shared = rows.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("k")
    shared = materialise(shared, "shared-bands")
    members = materialise(rows.join(shared, F.col("key") == F.col("k"), "left_semi"), "members")
    drop()
    return members


def minhash_duplicates(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 2, percent: int = 80
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every document.

    A document's set are its distinct ``width``-word shingles, A-Z lower-cased; with fewer words the
    whole sequence is one. Documents with ``100 * intersection >= percent * union`` are linked, and
    ``component_id`` is the smallest key reachable. Equal sets are one class from the start; classes
    that share a band are held against each other on their full sets, so a link is lost only if all
    bands miss it (5e-8 at 0.8).

    Null and empty texts, and texts without words, have an empty set and stay alone; null keys come
    last, a component of null keys has component null and is kept; repeated rows give repeated
    results; an empty table gives an empty table; other columns are not read.
    """
    (row,) = free_names(docs, "minhash_row")
    src = numbered(docs, row).select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    marked = materialise(banded(src, width), "banded")
    classes = marked.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("cid"), F.min("key").alias("first"))
    classes = materialise(classes, "classes")
    ids = classes.select("cid")
    reps = marked.select(F.col("row").alias("cid"), "n", "bands").join(ids, "cid", "left_semi")
    members = band_members(reps)
    asked = materialise(members.select("cid").distinct(), "candidates")
    # candidates grow with the documents, so they are never broadcast; their sets are built again, as texts are smaller
    texts = src.select(F.col("row").alias("cid"), "text").join(asked.hint("merge"), "cid", "left_semi")
    sets = materialise(shingle_sets(texts, "text", ["cid"], width), "candidate-sets")
    found = similar_components(members, sets, percent)
    roots = classes.join(found, F.col("cid") == F.col("node"), "left").select(
        F.col("d1").alias("e1"), F.col("d2").alias("e2"), "first", F.coalesce("root", "cid").alias("root")
    )
    roots = materialise(roots, "roots")
    lowest = roots.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("lowest"))
    roots = roots.join(materialise(lowest, "lowest"), F.col("root") == F.col("r"))
    roots = materialise(roots.select("e1", "e2", "lowest"), "roots")
    rows = marked.select("key", "n", "d1", "d2").join(roots, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    rows = rows.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("lowest")).alias("component_id"),
    )
    return rows.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
