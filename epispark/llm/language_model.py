"""Language-model scores by online logistic context mixing over binary decisions.

Frequent tokens are coded as paths in a binary code tree. At each node several bit predictors, with
hashed contexts, give their stretched probabilities; gated weights, selected by how well-known the
contexts are, mix them, and a text's own weights are refined as it is read. All other tokens are one
symbol of the tree, and then have their share of the corpus counts. Per-token costs add up to the
log10 probability of a text, and to its bits per byte.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.words import text_batches, whole
from epispark.session import materialise

HEAD = 1 << 18  # words whose counts every task knows, at most
CODED = 4096  # most frequent of them, coded bit by bit: so many at least, more in a large corpus
STOPS = 64  # most frequent words, whose last occurrences are contexts
SLOT_BITS = 18  # slots of a context table, at least
SLOTS_PER_WORD = 64  # and at least so many for each coded word
TASKS_PER_CORE = 4  # tasks that count contexts, each with tables of its own
CONTEXTS = 3
GATES = 16
FIRST_SEGMENT = 32  # tokens before a text's weights are first refined
SEGMENT = 256  # tokens between two later refinements, at most
PRIOR = 60.0  # pull of a text's weights to the common ones
BLOCK_TOKENS = 1 << 17
CHUNK = 1 << 13  # counters of a row, when partitions' context tables are added up
BUCKETS = 8  # count buckets a doubling, to find the head's smallest count
TUNING_FOLD = 9  # crc32 remainder of training documents that fit the mixing weights
LOG2_10 = float(np.log2(10))


def fold(key: str, mod: int = 10) -> Column:
    """crc32 of the key as text modulo ``mod``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod


def coded_words(tokens: int) -> int:
    """Symbols coded bit by bit, as far as the head has them: the square root of the corpus' tokens."""
    return max(CODED, math.isqrt(tokens))


def slot_bits(coded: int) -> int:
    """log2 of a context table's slots, which grow with the coded words."""
    return max(SLOT_BITS, (SLOTS_PER_WORD * coded - 1).bit_length())


def segments(longest: int) -> Iterator[tuple[int, int]]:
    """Token ranges between refinements, doubling from ``FIRST_SEGMENT`` to ``SEGMENT``."""
    s, step = 0, FIRST_SEGMENT
    while s < longest:
        yield s, s + step
        s, step = s + step, min(2 * step, SEGMENT)


def code_tree(counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Huffman code of the symbols: offsets, lengths, nodes and bits, and each node's zeros and ones."""
    n = len(counts)
    heap = [(int(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)
    zeros, ones = np.zeros(max(n - 1, 1)), np.zeros(max(n - 1, 1))
    node = n
    while len(heap) > 1:
        (ca, a), (cb, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a] = parent[b] = node
        side[b] = 1
        zeros[node - n], ones[node - n] = ca, cb
        heapq.heappush(heap, (ca + cb, node))
        node += 1
    root, nodes, bits, length = node - 1, [], [], []
    for s in range(n):
        path = []
        while s != root:
            path.append((parent[s] - n, side[s]))
            s = parent[s]
        nodes += [p for p, _ in reversed(path)]
        bits += [b for _, b in reversed(path)]
        length.append(len(path))
    length = np.array(length, np.int64)
    return np.cumsum(length) - length, length, np.array(nodes, np.int64), np.array(bits, np.int64), zeros, ones


def _read(z: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretched probability of a one, and how well-known it is, from zeros and ones."""
    stretch = np.log((o + 0.4) / (z + 0.4)).astype(np.float32)
    return stretch, np.searchsorted([1, 8, 64], z + o, side="right").astype(np.uint8)


@dataclass
class Model:
    """What a task needs to read texts; it grows with the square root of the corpus."""

    words: list[bytes]  # by falling count
    counts: np.ndarray
    ends: int  # training texts
    tokens: int
    distinct: int
    known_beyond: int  # distinct training words outside the head, they are few texts' words
    tables: np.ndarray | None = None  # zeros and ones per slot of every context
    weights: np.ndarray | None = None  # per gate and predictor
    stretch: np.ndarray | None = None  # what scoring reads of the tables
    sure: np.ndarray | None = None  # and how well-known each slot is
    tag: str = field(default_factory=lambda: uuid.uuid4().hex)

    def prepare(self) -> None:
        if hasattr(self, "ids"):
            return
        self.ids = {w: i + 1 for i, w in enumerate(self.words)}  # 0 is the end
        coded = min(coded_words(self.tokens), len(self.words) + 1)
        if self.tables is not None:
            self.stretch, self.sure = _read(self.tables[:, :, 0], self.tables[:, :, 1])
        slots = 1 << slot_bits(coded) if self.stretch is None else self.stretch.shape[1]
        self.slot_bits = slots.bit_length() - 1
        all_counts = np.r_[self.ends, self.counts].astype(np.float64)
        rest = self.tokens - all_counts[:coded].sum()
        self.coded = coded
        self.at, self.len, node, bit, zeros, ones = code_tree(np.r_[all_counts[:coded], rest] * 10 + 1)
        self.code = (node * 2 + bit).astype(np.uint32)
        self.base_stretch = np.log(ones / zeros).astype(np.float32) if coded else np.zeros(1, np.float32)
        # log10 (c + 0.1) of head words, and of the words that share the rest symbol
        self.smooth = np.log10(all_counts + 0.1)
        self.norm = np.log10(self.tokens + 0.1 * (self.distinct + 1))
        self.rest_norm = np.log10(rest + 0.1 * (self.distinct - coded + 1 + (self.ends == 0)))


_models: dict[str, Model] = {}


def _ready(broadcast) -> Model:
    """The broadcast model with its lookup tables, built once per Python worker."""
    model = broadcast.value
    if model.tag not in _models:
        _models.clear()
        model.prepare()
        _models[model.tag] = model
    return _models[model.tag]


def _token_blocks(texts: list[bytes], model: Model, strange: bool = True):
    """Blocks of whole texts: first text, ids of all tokens (-1 outside the head), tokens per text,
    and, if asked for, the words outside the head as (text, word) pairs."""
    start, ids, sizes, others, total = 0, [], [], [], 0
    get = model.ids.get
    for i, t in enumerate(texts):
        words = t.lower().split()
        own = np.fromiter(map(get, words, [-1] * len(words)), np.int32, len(words))
        if strange:
            others += [(i, words[j]) for j in np.flatnonzero(own < 0).tolist()]
        ids += [own, np.zeros(1, np.int32)]
        sizes.append(len(words) + 1)
        total += len(words) + 1
        if total >= BLOCK_TOKENS:
            yield start, np.concatenate(ids), np.array(sizes), others
            start, ids, sizes, others, total = i + 1, [], [], [], 0
    if sizes:
        yield start, np.concatenate(ids), np.array(sizes), others


def _contexts(ids: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[np.ndarray, ...]:
    """Per token: its symbol and the hash seeds of its contexts."""
    first = np.cumsum(sizes) - sizes
    rest = model.coded
    symbol = np.where((ids < 0) | (ids >= rest), rest, ids).astype(np.int64)
    previous = np.r_[0, symbol[:-1]]
    previous[first] = rest + 1
    # last and second-last of the most frequent words before the token, in the same text
    place = np.arange(len(ids))
    text_first = np.repeat(first, sizes)
    stop = (ids > 0) & (ids <= STOPS)
    seen = np.maximum.accumulate(np.where(stop, place, -1))
    seen = np.r_[-1, seen[:-1]]
    one = np.where(seen >= text_first, ids[np.maximum(seen, 0)], 0).astype(np.int64)
    back = seen[np.maximum(seen, 0)]
    two = np.where((seen >= text_first) & (back >= text_first), ids[np.maximum(back, 0)], 0)
    return symbol, previous, one, one * (STOPS + 1) + two.astype(np.int64)


def _bits(model: Model, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and bits of the symbols' codes, one after the other, and their number per symbol."""
    n = model.len[symbol]
    at = np.arange(n.sum()) + np.repeat(model.at[symbol] - (np.cumsum(n) - n), n)
    code = model.code[at]
    return code >> np.uint32(1), code & np.uint32(1), n


def _slots(
    node: np.ndarray, n: np.ndarray, seeds: Sequence[np.ndarray], bits: int
) -> Iterator[np.ndarray]:
    """Per context the slot of every bit, a hash of the context's seed and the node."""
    spread = node * np.uint32(0x9E3779B1)
    for k, seed in enumerate(seeds):
        mixed = (seed.astype(np.uint32) * np.uint32(8) + np.uint32(k + 1)) * np.uint32(0x85EBCA77)
        mixed ^= mixed >> np.uint32(15)
        h = (np.repeat(mixed, n) ^ spread) * np.uint32(0xC2B2AE3D)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x27D4EB2F)
        yield h >> np.uint32(32 - bits)


def _mix(model: Model, ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray, learn: bool):
    """Log-likelihood per text; with ``learn`` the gates' weights follow all texts instead.

    Texts are read segment by segment, all at once. After each, a text's own shift of the weights is
    the one-step maximum of its likelihood so far under a prior, a damped Newton step.
    """
    seeds = _contexts(ids, sizes, model)
    symbol, seeds = seeds[0], seeds[1:]
    first = np.cumsum(sizes) - sizes
    n_texts, width = len(sizes), CONTEXTS + 1
    total = np.zeros(n_texts)
    shift = np.zeros((n_texts, width), np.float32)
    grad, curve = np.zeros((n_texts, width)), np.zeros((n_texts, width))
    order = np.argsort(-sizes, kind="stable")
    gates_a = np.zeros((GATES, width, width))
    gates_b = np.zeros((GATES, width))
    columns = weights.astype(np.float32).T.copy()
    for s, end in segments(int(sizes.max())):
        who = np.sort(order[: int((sizes > s).sum())])
        size = np.minimum(sizes[who], end) - s
        tokens = np.arange(size.sum()) + np.repeat(first[who] + s - (np.cumsum(size) - size), size)
        node, bit, n = _bits(model, symbol[tokens])
        n_bits = np.add.reduceat(n, np.cumsum(size) - size)
        x = [model.base_stretch[node]]
        gate = None
        for k, slot in enumerate(_slots(node, n, [y[tokens] for y in seeds], model.slot_bits)):
            x.append(model.stretch[k][slot])
            if k in (0, CONTEXTS - 1):
                sure = model.sure[k][slot]
                gate = sure * np.uint8(4) if gate is None else gate + sure
        z = np.zeros(len(node), np.float32)
        for k in range(width):
            w = columns[k][gate]
            if s:
                w += np.repeat(shift[who, k], n_bits)
            z += w * x[k]
        sign = bit.astype(np.float32) * 2 - 1
        q = 1 / (1 + np.exp(np.clip(-sign * z, -20, 20)))  # probability of the bit that came
        starts = np.cumsum(n_bits) - n_bits
        total[who] += np.add.reduceat(np.log(q), starts, dtype=np.float64)
        err = (1 - q) * sign
        h = q * (1 - q)
        if learn:
            for k in range(width):
                gates_b[:, k] += np.bincount(gate, err * x[k], GATES)
                for j in range(k, width):
                    a = np.bincount(gate, h * x[k] * x[j], GATES)
                    gates_a[:, k, j] += a
                    if j != k:
                        gates_a[:, j, k] += a
            continue
        if (sizes[who] > end).any():
            for k in range(width):
                grad[who, k] += np.add.reduceat(err * x[k], starts)
                curve[who, k] += np.add.reduceat(h * x[k] * x[k], starts)
            shift[who] = np.clip(shift[who] + grad[who] / (curve[who] + PRIOR) * 0.5, -1, 1)
            grad[who] *= 0.5
    return total, gates_a, gates_b


# ----------------------------------------------------------------------------------- Spark jobs


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter

    counts: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "n"],
        )

    for batch in batches:
        for t in batch.column(0):
            counts.update(t.as_py().lower().split())
            if len(counts) > 400_000:
                yield out()
                counts.clear()
    yield out()


def _count_bits(broadcast):
    """A partition's context tables, as rows of ``CHUNK`` counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(broadcast)
        cells = 2 << model.slot_bits
        sums = np.zeros((CONTEXTS, cells), np.uint32)
        for batch in batches:
            for _, ids, sizes, _ in _token_blocks(batch.column(0).to_pylist(), model, strange=False):
                symbol, *seeds = _contexts(ids, sizes, model)
                node, bit, n = _bits(model, symbol)
                for k, slot in enumerate(_slots(node, n, seeds, model.slot_bits)):
                    sums[k] += np.bincount(slot * np.uint32(2) + bit, minlength=cells).astype(np.uint32)
        yield from _chunk_rows(dict(enumerate(sums.reshape(-1, CHUNK))))

    return run


def _chunk_rows(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    some = {c: v for c, v in sums.items() if v.any()}
    raw = [v.astype("<u4").tobytes() for v in some.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(some), pa.int32()), pa.array(raw, pa.binary())], names=["chunk", "counts"]
    )


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per chunk as what scoring reads; a task holds one running sum per chunk."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = np.frombuffer(raw.as_buffer(), "<u4").astype(np.int64)
            sums[c] = sums[c] + v if c in sums else v
    stretch, sure = [], []
    for v in sums.values():
        x, known = _read(v[::2], v[1::2])
        stretch.append(x.astype("<f4").tobytes())
        sure.append(known.tobytes())
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array(stretch, pa.binary()), pa.array(sure, pa.binary())],
        names=["chunk", "stretch", "sure"],
    )


def _tune(broadcast):
    """Sums of curvature and curvature times weights per gate, so that partitions average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _ready(broadcast)
        width = CONTEXTS + 1
        weights = np.full((GATES, width), 1 / width)
        curve = np.tile(np.eye(width) * 10.0, (GATES, 1, 1))
        for batch in batches:
            for _, ids, sizes, _ in _token_blocks(batch.column(0).to_pylist(), model, strange=False):
                _, a, b = _mix(model, ids, sizes, weights, learn=True)
                curve = 0.7 * curve + a
                weights = weights + np.linalg.solve(curve, b[:, :, None])[:, :, 0]
        moved = (curve @ weights[:, :, None])[:, :, 0]
        flat = np.concatenate([curve.ravel(), moved.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["place", "v"]
        )

    return run


def _score(broadcast):
    """Per text one row of kind 0, and its words outside the head as rows of kind 1."""
    names = ["kind", "row", "n_bytes", "n_tokens", "n_known", "base", "model", "word", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        model = _ready(broadcast)
        ln10 = np.log(10)
        for batch in batches:
            texts, rows = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for start, ids, sizes, strange in _token_blocks(texts, model):
                first = np.cumsum(sizes) - sizes
                total, _, _ = _mix(model, ids, sizes, model.weights, learn=False)
                known = ids >= 0
                smooth = np.where(known, model.smooth[np.maximum(ids, 0)], 0.0)
                rest = ~known | (ids >= model.coded)
                add = lambda v: np.add.reduceat(np.asarray(v, np.float64), first)
                base = add(smooth - model.norm)
                score = total / ln10 + add(np.where(rest, smooth - model.rest_norm, 0.0))
                n, own = len(sizes), rows[start : start + len(sizes)]
                size = [len(t) for t in texts[start : start + n]]
                none = pa.nulls(n, pa.binary())
                seen = add(known & ((ids > 0) | (model.ends > 0)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n, np.int32)), pa.array(own), pa.array(size, pa.int64()),
                     pa.array(sizes.astype(np.int64)), pa.array(seen.astype(np.int64)),
                     pa.array(base), pa.array(score), none, pa.array(np.zeros(n, np.int64))],
                    names=names,
                )
                if strange:
                    pairs = Counter(strange)
                    m = len(pairs)
                    at = rows[np.fromiter((i for i, _ in pairs), np.int64, m)]
                    nothing = pa.nulls(m, pa.int64())
                    real = pa.nulls(m, pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ones(m, np.int32)), pa.array(at), nothing, nothing, nothing, real, real,
                         pa.array([w for _, w in pairs], pa.binary()), pa.array(list(pairs.values()), pa.int64())],
                        names=names,
                    )

    return run


def _head(counts: DataFrame, limit: int) -> tuple[list[bytes], np.ndarray]:
    """The most frequent words, at most ``limit``: those above the count where their number fits.

    A histogram of counts on a logarithmic scale finds the limit, so no global sort is needed.
    """
    bucket = F.floor(F.log2("c") * BUCKETS).cast("int")
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"))
    total, least = 0, None
    for r in sorted(sizes.collect(), key=lambda r: -r["b"]):
        total += r["n"]
        if total > limit:
            break
        least = r["low"]
    if least is None:
        return [], np.zeros(0, np.int64)
    top = counts.where(F.col("c") >= least).toArrow()
    words, c = top.column("word").to_pylist(), top.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
    return [bytes(words[i]) for i in order], c[order].astype(np.int64)


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the table of word counts (``word, c``), from rows ``(data, part)``.

    All training words are counted exactly. Context tables come from the texts outside the tuning
    fold, mixing weights from those in it, so that they value contexts by what these say of new text.
    """
    spark = texts.sparkSession
    words = texts.select("data").mapInArrow(_word_counts, "word binary, n long")
    counts = materialise(words.groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = texts.count()
    head, c = _head(counts, HEAD)
    model = Model(head, c, ends, total + ends, distinct + (ends > 0), distinct - len(head))
    sent = spark.sparkContext.broadcast(model)
    bulk = texts.where(F.col("part") != TUNING_FOLD).select("data")
    # few tasks, since each hands on tables of its own: their bytes follow the tables, not the input
    bulk = bulk.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    coded = min(coded_words(total + ends), len(head) + 1)
    slots = CONTEXTS << slot_bits(coded)
    stretch, sure, half = np.zeros(slots, np.float32), np.zeros(slots, np.uint8), CHUNK // 2
    rows = bulk.mapInArrow(_count_bits(sent), "chunk int, counts binary").repartition("chunk")
    for r in rows.mapInArrow(_add_chunks, "chunk int, stretch binary, sure binary").collect():
        at = slice(r["chunk"] * half, r["chunk"] * half + half)
        stretch[at], sure[at] = np.frombuffer(r["stretch"], "<f4"), np.frombuffer(r["sure"], np.uint8)
    model = Model(head, c, ends, total + ends, distinct + (ends > 0), distinct - len(head),
                  stretch=stretch.reshape(CONTEXTS, -1), sure=sure.reshape(CONTEXTS, -1))
    sent = spark.sparkContext.broadcast(model)
    tuning = texts.where(F.col("part") == TUNING_FOLD).select("data")
    sums = tuning.mapInArrow(_tune(sent), "place int, v double").groupBy("place").agg(F.sum("v").alias("v"))
    width, flat = CONTEXTS + 1, np.zeros(GATES * (CONTEXTS + 1) * (CONTEXTS + 2))
    for r in sums.collect():
        flat[r["place"]] = r["v"]
    cut = GATES * width * width
    curve = flat[:cut].reshape(GATES, width, width) + np.eye(width) * 1e-6
    moved = flat[cut:].reshape(GATES, width) + 1e-6 / width
    model.weights = np.linalg.solve(curve, moved[:, :, None])[:, :, 0]
    model.tag = uuid.uuid4().hex
    return model, counts


def score_texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    Training texts are those whose key's crc32 modulo 10 is not 0. Counts of frequent words go to
    every task, in a table of bounded size; the others are joined by word, and since none of them is
    frequent, no key is hot.

    Null text counts as empty, one end token. Null keys are held out of training and get
    ``held_out`` false. Repeated rows count and are scored each. Without training texts every known
    count is 0. An empty table gives an empty table; other columns are not read.
    """
    spark = docs.sparkSession
    text_batches(spark)
    part = fold(key)
    src = docs.select(F.col(key).alias("id"), whole(text).cast("binary").alias("data"), part.alias("part"))
    model, counts = train(src.where(F.col("part") != 0).select("data", "part"))
    sent = spark.sparkContext.broadcast(model)
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), whole(text).cast("binary").alias("data")
    )
    schema = (
        "kind int, row struct<r: long, id: {}>, n_bytes long, n_tokens long, n_known long, "
        "base double, model double, word binary, n long"
    ).format(numbered.schema["id"].dataType.simpleString())
    scored = materialise(_scored(numbered, sent, schema), "scores")
    parts = scored.where("kind = 0").select("row.*", "n_bytes", "n_tokens", "n_known", "base", "model")
    strange = scored.where("kind = 1").select(F.col("row.r").alias("r2"), "word", "n")
    strange = strange.join(counts, "word", "left").groupBy("r2").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))).alias("smooth"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
    )
    rows = parts.join(strange, F.col("r") == F.col("r2"), "left")
    more = F.coalesce("smooth", F.lit(0.0))
    score = F.col("model") + more
    return rows.select(
        F.col("id").alias(key),
        F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 10 == 0, F.lit(False)).alias("held_out"),
        "n_bytes",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        score.alias("score"),
        (-score * LOG2_10 / F.when(F.col("n_bytes") > 0, F.col("n_bytes"))).alias("bits_per_byte"),
    )


def _scored(numbered: DataFrame, sent, schema: str) -> DataFrame:
    run = _score(sent)

    def with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``row`` numbers texts; it is handed on with the key, which may be of any type."""
        for batch in batches:
            row, ids = batch.column(0).to_numpy(), batch.column(1)
            places = pa.RecordBatch.from_arrays([pa.array(range(len(row)), pa.int64()), batch.column(2)], names=["row", "data"])
            for out in run(iter([places])):
                at = out.column(1)
                both = pa.StructArray.from_arrays([batch.column(0).take(at), ids.take(at)], names=["r", "id"])
                yield pa.RecordBatch.from_arrays([out.column(0), both, *out.columns[2:]], names=out.schema.names)

    return numbered.mapInArrow(with_ids, schema)
