"""SimHash near-duplicates at a set similarity, by deletion-variant signatures.

Two sets of similarity 0.8 differ in 15% of their SimHash bits, so fingerprints of 64 bits do not tell
them apart and no number of segments makes one differ by at most one bit for certain. Fingerprints are
therefore 512 bits: 21 segments of 18 bits, each indexed as it is and with each of its 4 least decided
bits wildcarded, and 128 bits that a task compares before it names a candidate. Candidates are confirmed
on their full sets: a link is never false, and is lost only if all segments miss it (see ``BITS``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.linking import similar_components
from epispark.llm.wordhash import U, mix, shingles, word_hashes
from epispark.llm.words import free_names, numbered, text_batches
from epispark.session import materialise, scratch_table

#: Of two sets of similarity 0.8 / 0.9 a segment differs in none or one wildcarded bit with chance
#: 0.123 / 0.321, so all segments miss with chance 0.06 / 0.0003. Wider segments meet fewer strangers:
#: raise both numbers for more than some 10^8 documents.
BITS = 18
SEGMENTS = 21
WEAK = 4
CHECK = 32  # of 128: expected 19.4 at similarity 0.8, standard deviation 4.1; strangers differ in 64
LANES = 8  # 64-bit hashes of a shingle; the last two lanes are what tasks compare
STEPS = np.array([j * 0x9E3779B97F4A7C15 % (1 << 64) for j in range(1, LANES + 1)], U)  # from lane to lane
AT_ONCE = 1 << 14
SMALL_GROUP = 48  # groups up to here are compared by shifted arrays, many groups at once
LARGE_GROUP = 8192  # groups beyond are cut into slots, and pairs of slots become groups
ROUNDS = 0  # tasks name the first pairs while they hold a group, so no star is joined; tiles take what is left


def margins(hashes: np.ndarray) -> np.ndarray:
    """Of every fingerprint bit, how many more shingles have a one than a zero."""
    ones = np.zeros(64 * LANES, np.int64)
    for k in range(0, len(hashes), AT_ONCE):
        part = hashes[k : k + AT_ONCE]
        lanes = mix(part[:, None] + STEPS)
        bits = np.unpackbits(lanes.view(np.uint8).reshape(len(part), 8 * LANES), axis=1)
        for i in range(0, len(part), 255):
            ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return 2 * ones - len(hashes)


def signature(margin: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Keys of all segments with none or one weak bit wildcarded, and the 128 bits to compare."""
    bits = margin > 0
    own = bits[: SEGMENTS * BITS].reshape(SEGMENTS, BITS)
    value = own @ (1 << np.arange(BITS))
    weak = np.abs(margin[: SEGMENTS * BITS]).reshape(SEGMENTS, BITS).argsort(axis=1, kind="stable")[:, :WEAK]
    place = np.concatenate([np.full((SEGMENTS, 1), BITS), weak], axis=1)
    wild = np.concatenate([value[:, None], value[:, None] & ~(1 << weak)], axis=1)
    keys = (np.arange(SEGMENTS)[:, None] * (BITS + 1) + place << BITS) | wild
    return keys.ravel(), np.packbits(bits[-128:]).tobytes()


def _lists(parts: list[np.ndarray], kind: type) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts).astype(kind, copy=False) if parts else np.zeros(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles."""
    words, _, _ = word_hashes(text or b"", lower=True)
    own = np.sort(shingles(words, width))
    return own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own


def _over_texts(docs: DataFrame, text: str, keep: list[str], fields: list[T.StructField], columns) -> DataFrame:
    """``keep`` columns and those that ``columns`` makes of a batch's texts, as bytes or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = columns(v.as_py() for v in batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=schema.names)

    text_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text).cast("string").cast("binary").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], *fields])
    return src.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, text: str, keep: list[str], width: int) -> DataFrame:
    """``keep`` columns and ``n, shingles``: the set of shingle hashes of every document, and its size."""

    def columns(texts):
        sets = [_set(t, width).view(np.int64) for t in texts]
        return pa.array(list(map(len, sets)), pa.int64()), _lists(sets, np.int64)

    fields = [T.StructField("n", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]
    return _over_texts(docs, text, keep, fields, columns)


def signatures(docs: DataFrame, text: str, keep: list[str], width: int) -> DataFrame:
    """``keep`` columns and ``n, d1, d2, low, high, variants`` of every document: the size of its set of
    shingle hashes and its 128-bit digest, the bits to compare and the keys. Null text is empty."""

    def columns(texts):
        n, digests, check, keys = [], [], [], []
        for text in texts:
            own = _set(text, width)
            key, bits = signature(margins(own))
            n.append(len(own))
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            check.append(bits)
            keys.append(key if len(own) else key[:0])
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        c = np.frombuffer(b"".join(check), np.int64).reshape(-1, 2)
        longs = (np.array(n, np.int64), d[:, 0], d[:, 1], c[:, 0], c[:, 1])
        return *map(pa.array, longs), _lists(keys, np.int32)

    fields = [T.StructField(c, T.LongType()) for c in ("n", "d1", "d2", "low", "high")]
    return _over_texts(docs, text, keep, [*fields, T.StructField("variants", T.ArrayType(T.IntegerType()))], columns)


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of differing bits of rows of two 64-bit values."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint8)


def _near(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which rows, sorted by key, have another row of their key within ``CHECK`` bits."""
    both = np.stack([low, high], axis=1).view(np.uint64)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    mark = np.zeros(len(key), bool)
    small = np.flatnonzero(np.repeat((size > 1) & (size <= SMALL_GROUP), size))
    k, v = key[small], both[small]
    for d in range(1, SMALL_GROUP):
        at = np.flatnonzero(k[d:] == k[:-d]) if len(k) > d else small[:0]
        if not len(at):
            break
        at = at[_differ(v[at], v[at + d]) <= CHECK]
        mark[small[at]] = mark[small[at + d]] = True
    for start, n in zip(first[size > SMALL_GROUP].tolist(), size[size > SMALL_GROUP].tolist()):
        v = both[start : start + n]
        for i in range(0, n, 128):
            near = _differ(v[i : i + 128, None], v[None, :]) <= CHECK
            mark[start + i : start + i + len(near)] = near.sum(axis=1) > 1
    return mark


def _smallest(key: np.ndarray, cid: np.ndarray) -> np.ndarray:
    """Of rows sorted by key, the smallest ``cid`` of each one's key."""
    if not len(key):
        return cid
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return np.repeat(np.minimum.reduceat(cid, first), np.diff(np.r_[first, len(key)]))


def _candidates(large: int | None):
    """Rows ``key, cid, low, high`` sorted by key: those near another one as kind 0, with the smallest such ``cid`` of
    their key as ``hub``; all rows of larger groups as kind 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(kind: int, *rows: np.ndarray) -> pa.RecordBatch:
            if kind == 0:
                key, _, low, high = rows
                mark = _near(key, low, high)
                rows = tuple(a[mark] for a in rows)
            hub = _smallest(*rows[:2]) if kind == 0 else rows[1]
            columns = [pa.array(np.full(len(rows[0]), kind, np.int32)), *map(pa.array, rows), pa.array(hub)]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "cid", "low", "high", "hub"])

        held = [np.zeros(0, np.int64)] * 4
        huge = None
        for batch in batches:
            held = [np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(held)]
            if huge is not None:
                n = int(np.searchsorted(held[0], huge, side="right"))
                yield answer(1, *(a[:n] for a in held))
                held = [a[n:] for a in held]
                huge = huge if not len(held[0]) else None
            if len(held[0]) < 1 << 16:
                continue
            n = int(np.searchsorted(held[0], held[0][-1]))
            if n:
                yield answer(0, *(a[:n] for a in held))
                held = [a[n:] for a in held]
            if large is not None and len(held[0]) > large:
                huge = int(held[0][-1])
                yield answer(1, *held)
                held = [a[:0] for a in held]
        if len(held[0]):
            yield answer(0, *held)

    return run


def _marked(rows: DataFrame, large: int | None) -> DataFrame:
    dealt = rows.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_candidates(large), "kind int, key long, cid long, low long, high long, hub long")


def candidate_groups(rows: DataFrame, large: int = LARGE_GROUP) -> DataFrame:
    """``key, cid, hub`` of all rows (``key, cid, low, high``) that are near another row of their key; ``hub`` is
    the smallest ``cid`` of these rows.

    Groups over ``large`` rows are dealt into slots by hash and each pair of slots is a group of its
    own, so all pairs are compared and none is listed.
    """
    found = materialise(_marked(rows, large), "candidates")
    near = found.where("kind = 0").select("key", "cid", "hub")
    rest = found.where("kind = 1").select("key", "cid", "low", "high")
    if rest.isEmpty():
        return near
    sizes = rest.groupBy(F.col("key").alias("k")).agg(F.ceil(F.count(F.lit(1)) / (large // 4)).cast("int").alias("g"))
    slots = rest.join(sizes, F.col("key") == F.col("k")).withColumn("s", F.pmod(F.xxhash64("cid"), "g"))
    slots = slots.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    pair = F.xxhash64("key", F.least("s", "t"), F.greatest("s", "t"))
    return near.unionByName(_marked(slots.select(pair.alias("key"), "cid", "low", "high"), None).select("key", "cid", "hub"))


def first_pairs(groups: DataFrame) -> DataFrame:
    """Up to three pairs ``a, b`` of every row of ``groups`` (``key, cid, hub``) and hubs of its groups: the smallest, the
    largest and one by hash. They grow with the rows, however many groups a row is in."""
    hubs = [F.min("hub"), F.max("hub"), F.min_by("hub", F.xxhash64("hub"))]
    asks = groups.where("hub <> cid").groupBy(F.col("cid").alias("b")).agg(F.array_distinct(F.array(*hubs)).alias("hubs"))
    return asks.select(F.explode("hubs").alias("a"), "b")


def keep_first_similar(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, percent: int = 80
) -> DataFrame:
    """The documents of ``docs``, of each near-duplicate group one row: that with the smallest key.

    A document's set are its distinct ``width``-word shingles, A-Z lower-cased; with fewer words the
    whole sequence is one. Documents with ``100 * intersection >= percent * union`` are linked, and a
    group is what links reach. Equal sets are one class from the start.

    Null texts, empty texts and texts without words are copies of one another, and linked with nothing
    else. Null keys come last; of rows that share the smallest key, or have no key, the one with the
    lowest row number stays, so repeated rows leave one. An empty table gives an empty table; other
    columns are carried along.
    """
    row, k = free_names(docs, "kept_row", "kept_key")
    docs = numbered(docs, row)
    src = docs.select(F.col(row).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    marked, drop_marked = scratch_table(signatures(src, "text", ["row", "key"], width), "signatures")
    order = F.struct(F.col("key").isNull().alias("none"), "key", "row")
    classes = marked.groupBy("d1", "d2").agg(F.min(order).alias("first"))
    classes, drop_classes = scratch_table(classes.select(F.col("first.row").alias("cid"), "first"), "classes")
    reps = marked.where("n > 0").withColumnRenamed("row", "cid").join(classes.select("cid"), "cid", "left_semi")
    variants = reps.select(F.explode(F.col("variants").cast("array<long>")).alias("key"), "cid", "low", "high")
    asked, drop_asked = scratch_table(candidate_groups(variants), "near-rows")
    near = materialise(asked.select(F.col("cid").alias("near")).distinct(), "near")
    # few are near: their sets are built again; both semi-joins of texts are with rows that grow with the
    # documents, so they are shuffled at every size
    texts = src.join(near.hint("merge"), F.col("row") == F.col("near"), "left_semi")
    sets, drop_sets = scratch_table(shingle_sets(texts.withColumnRenamed("row", "cid"), "text", ["cid"], width), "candidate-sets")
    members = materialise(asked.join(sets.select("cid", "n"), "cid").select("key", "cid", "n"), "members")
    first = materialise(first_pairs(asked), "first-pairs")
    drop_asked()
    found = similar_components(members, sets, percent, ROUNDS, first=first)
    roots = classes.join(found, F.col("cid") == F.col("node"), "left")
    first = roots.groupBy(F.coalesce("root", "cid").alias("root")).agg(F.min("first").alias("first"))
    kept = materialise(first.select(F.col("first.row").alias(k)), "kept")
    for drop in (drop_marked, drop_classes, drop_sets):
        drop()
    return docs.join(kept.hint("merge"), F.col(row) == F.col(k), "left_semi").drop(row)
