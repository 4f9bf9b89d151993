"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.components import components
from epispark.llm.words import free_names, numbered, text_batches
from epispark.session import materialise

SEED = 42
SHINGLES_AT_ONCE = 1 << 16
#: 64 bits cut into 3 segments: of 4 or fewer differing bits, one segment holds at most one.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
DISTANCE = 4
SMALL_GROUP = 48  # groups up to here are compared by shifted arrays, many groups at once
LARGE_GROUP = 8192  # groups beyond are cut into slots, and pairs of slots become groups


def fingerprint(text: bytes, width: int = 4) -> bytes:
    """64-bit SimHash of the word shingles, big-endian; zero for a text without words."""
    import xxhash

    words = text.lower().split()
    if not words:
        return b"\0" * 8
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1 :][:n]
    ones = np.zeros(64, np.int64)
    for k in range(0, n, SHINGLES_AT_ONCE):
        a, b = starts[k : k + SHINGLES_AT_ONCE].tolist(), ends[k : k + SHINGLES_AT_ONCE].tolist()
        shingles = [joined[i:j] for i, j in zip(a, b)]
        raw = b"".join(map(xxhash.xxh64_digest, shingles, repeat(SEED)))
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(
    docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), width: int = 4
) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            raw = b"".join(fingerprint(t.as_py() or b"", width) for t in texts)
            fp = pa.array(np.frombuffer(raw, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], fp], names=[*batch.schema.names[:-1], "fp"]
            )

    text_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text).cast("string").cast("binary").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return src.mapInArrow(run, schema)


def variants(fps: DataFrame) -> DataFrame:
    """``key, fp``: each segment's value, and the value with each one bit wildcarded.

    Keys carry the segment and the wildcard's place. Of two fingerprints that meet under a wildcard
    key with equal bits at its place, the segment's own key brings them together already.
    """
    keys = []
    for s, (low, width) in enumerate(SEGMENTS):
        value = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        base = s * 32 << 24
        keys.append(value + F.lit(base + (31 << 24)))
        for j in range(width):
            keys.append(value.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << j))) + F.lit(base + (j << 24)))
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) with the same components as the edges (a, b)."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= DISTANCE


def _within(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges of one group of fingerprints, compared tile by tile."""
    a = b = np.zeros(0, np.int64)
    for i in range(0, len(group), 128):
        near = _close(group[i : i + 128, None], group[None, i:])
        x, y = np.nonzero(near)
        a, b = np.concatenate([a, group[i + x]]), np.concatenate([b, group[i + y]])
        if len(a) > 1 << 19:
            a, b = _roots(a, b)
    return _roots(a, b) if len(a) else (a, b)


def _linker(large: int | None):
    """Sorted (key, fp) rows to star edges; rows of larger groups come back as kind 1."""

    def groups(key: np.ndarray, fp: np.ndarray):
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        found_a, found_b = [], []
        small = np.repeat(size <= SMALL_GROUP, size) & np.repeat(size > 1, size)
        k, f = key[small], fp[small]
        for d in range(1, SMALL_GROUP):
            if len(k) <= d:
                break
            at = np.flatnonzero(k[d:] == k[:-d])
            if not len(at):
                break
            at = at[_close(f[at], f[at + d])]
            found_a.append(f[at])
            found_b.append(f[at + d])
        for start, n in zip(first[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist()):
            a, b = _within(fp[start : start + n])
            found_a.append(a)
            found_b.append(b)
        a = np.concatenate(found_a) if found_a else fp[:0]
        b = np.concatenate(found_b) if found_b else fp[:0]
        return _roots(a, b) if len(a) else (a, b)

    def batch_of(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(a), kind), pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.int64)
        huge = None
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy()])
            if huge is not None:
                n = int(np.searchsorted(key, huge, side="right"))
                yield batch_of(1, key[:n], fp[:n])
                key, fp = key[n:], fp[n:]
                huge = huge if not len(key) else None
            if len(key) < 1 << 16:
                continue
            n = int(np.searchsorted(key, key[-1]))
            if n:
                yield batch_of(0, *groups(key[:n], fp[:n]))
                key, fp = key[n:], fp[n:]
            if large is not None and len(key) > large:
                huge = int(key[-1])
                yield batch_of(1, key, fp)
                key, fp = key[:0], fp[:0]
        if len(key):
            yield batch_of(0, *groups(key, fp))

    return run


def _linked(rows: DataFrame, large: int | None) -> DataFrame:
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_linker(large), "kind int, a long, b long")


def links(fps: DataFrame, large: int = LARGE_GROUP) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints with the components of all links of 4 bits or less.

    Variants meet by their key. A task compares the fingerprints of a group and answers with at most
    one edge per fingerprint, never with all pairs. Groups over ``large`` rows are dealt into slots
    by hash, each pair of slots is a group, and all of these are compared: nothing is left out.
    """
    found = materialise(_linked(variants(fps.select("fp").distinct()), large), "simhash-links")
    rest = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    edges = found.where("kind = 0").select("a", "b")
    if rest.isEmpty():
        return edges
    sizes = rest.groupBy(F.col("key").alias("k")).agg(
        F.ceil(F.count(F.lit(1)) / (large // 4)).cast("int").alias("g")
    )
    slots = rest.join(sizes, F.col("key") == F.col("k")).withColumn("s", F.pmod(F.hash("fp"), "g"))
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    pairs = slots.select("key", "fp", "s", other.alias("t")).select(
        F.xxhash64("key", F.least("s", "t"), F.greatest("s", "t")).alias("key"), "fp"
    )
    again = _linked(pairs, None).where("kind = 0").select("a", "b")
    return edges.unionByName(again)


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    width: int = 4,
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` of every document.

    Documents whose fingerprints differ in 4 bits or fewer are linked; ``component_id`` is the
    smallest key reachable. Texts are read once; equal fingerprints are one class from there on.

    Null and empty texts, and texts without words, have fingerprint zero and are linked like any
    other. Null keys come last: a component of null keys only has component null. Repeated rows give
    repeated results. An empty table gives an empty table; other columns are not read.
    """
    return _grouped(docs, text, key, width).select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _grouped(docs: DataFrame, text: str, key: str, width: int, *carry: str) -> DataFrame:
    """``key``, ``carry``, ``fp``, ``component_id``; and with ``carry`` the component's ``root``."""
    marked = materialise(fingerprints(docs, text, (key, *carry), width), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min(key).alias("first"))
    found = components(links(classes), "a", "b")
    members = classes.join(found, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("cfp"), "first", F.coalesce("root", "fp").alias("root")
    )
    lowest = members.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    members = members.join(lowest, F.col("root") == F.col("r")).select("cfp", "component_id", *(["root"] if carry else []))
    members = materialise(members, "members")  # a fingerprint of many copies can then be split
    return marked.join(members, F.col("fp") == F.col("cfp")).drop("cfp")


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4) -> DataFrame:
    """The documents of ``docs``, of each near-duplicate group one row: that with the smallest key.

    Null keys come last. Of rows that share the smallest key, or have no key, the one with the lowest
    row number stays.
    """
    row, k = free_names(docs, "kept_row", "kept_key")
    docs = numbered(docs, row)
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(row).alias("row"))
    first = _grouped(docs, text, key, width, row).groupBy("root").agg(F.min(order).alias("first"))
    kept = first.select(F.col("first.row").alias(k))
    return docs.join(kept, F.col(row) == F.col(k), "left_semi").drop(row)
