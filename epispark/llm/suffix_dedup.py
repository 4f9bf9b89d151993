"""Removal of long repeated byte strings through sorted suffixes.

A 400-byte string is found through its minimiser, the 64-byte piece with the lowest hash in it, so
equal strings have equal minimisers at the same place. Only suffixes at minimisers that occur more
than once can start a repeat; these are sorted, forwards and backwards from the minimiser, by
deep-shallow sorting, and the common-prefix lengths tell which strings around it repeat.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.deep_shallow import deep_shallow_sort
from epispark.llm.wordhash import word_hashes
from epispark.llm.words import free_names, text_batches
from epispark.session import materialise, scratch_table

LENGTH = 400
PIECE = 64
WORD = 8  # bytes of a word hash
BUFFER = 1 << 16  # windows whose hashes a task holds at once
DENSE = 192  # groups up to here compare common prefixes in a matrix
LARGE_GROUP = 20_000  # distinct contexts of one minimiser that a task sorts
POS_BITS = 20
U = np.uint64


class Anchors:
    """Minimisers of all ``length``-byte windows of byte strings, with hashes of their contexts."""

    def __init__(self, length: int = LENGTH, piece: int = PIECE):
        self.length, self.piece, self.side = length, piece, length - piece
        self.margin = length + self.side
        self.room = BUFFER + length + 2 * self.margin  # longest piece of a text
        n = self.room + 1
        base = 0x9E3779B97F4A7C15
        self.pow = np.cumprod(np.r_[U(1), np.full(n, U(base))])
        self.inv = np.cumprod(np.r_[U(1), np.full(n, U(pow(base, -1, 1 << 64)))])
        self.table = np.random.default_rng(7).integers(1, 1 << 63, 256, np.int64).astype(U)

    @staticmethod
    def mix(v: np.ndarray) -> np.ndarray:
        v = (v ^ (v >> U(32))) * U(0xD6E8FEB86659FD93)
        v = (v ^ (v >> U(29))) * U(0xBF58476D1CE4E5B9)
        return v ^ (v >> U(32))

    def pieces(self, sizes: list[int]) -> Iterator[list[tuple[int, int, int, int, int]]]:
        """Buffers as lists of (text, from, to, first window, last window + 1); texts may be cut."""
        held, total = [], 0
        for i, size in enumerate(sizes):
            for w in range(0, size - self.length + 1, BUFFER):
                stop = min(w + BUFFER, size - self.length + 1)
                lo, hi = max(0, w - self.margin), min(size, stop - 1 + self.length + self.margin)
                if held and total + hi - lo > self.room:
                    yield held
                    held, total = [], 0
                held.append((i, lo, hi, w, stop))
                total += hi - lo
        if held:
            yield held

    def of(self, texts: list[bytes]):
        """Per anchor: text number, position, bytes of context before and after, the offsets of the
        windows whose minimiser it is (lowest * 65536 + highest), two hashes, and how far and how
        many anchors a run of equal contexts goes on."""
        k, side = self.piece, self.side
        last = (-1, -1)
        for held in self.pieces([len(t) for t in texts]):
            data = np.frombuffer(b"".join(texts[i][lo:hi] for i, lo, hi, _, _ in held), np.uint8)
            n = len(data)
            sums = np.r_[U(0), np.cumsum(self.table[data] * self.pow[:n])]
            grams = self.mix((sums[k:] - sums[:-k]) * self.inv[: n - k + 1])
            low = (grams >> U(POS_BITS) << U(POS_BITS)) | np.arange(len(grams), dtype=U)
            span, want = 1, side + 1
            while 2 * span <= want:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < want:
                low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
            who, lo, hi, w0, w1 = (np.array(x, np.int64) for x in zip(*held))
            base = np.cumsum(hi - lo) - (hi - lo)
            mark = np.zeros(n + 1, np.int8)
            mark[base + w0 - lo] += 1
            np.subtract.at(mark, base + w1 - lo, 1)
            window = np.flatnonzero(np.cumsum(mark[: len(low)]))
            at = (low[window] & U((1 << POS_BITS) - 1)).astype(np.int64)
            head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            highest, at = at[head] - window[head], at[head]
            lowest = at - window[np.r_[head[1:], len(window)] - 1]
            row = np.searchsorted(base, at, side="right") - 1
            ends = np.r_[row[1:] != row[:-1], True]  # a cut text's last anchor may have more windows
            lowest[ends] = 0
            own = lowest * 65536 + highest
            text, pos = who[row], at - base[row] + lo[row]
            seen = (text == last[0]) & (pos <= last[1])  # found by the cut text's piece before
            at, row, text, pos, own = (x[~seen] for x in (at, row, text, pos, own))
            if not len(at):
                continue
            last = (int(text[-1]), int(pos[-1]))
            size = np.array([len(texts[i]) for i in who.tolist()], np.int64)[row]
            before, after = np.minimum(pos, side), np.minimum(size - pos, self.length)
            begin, stop = at - before, at + after
            ctx = (sums[stop] - sums[begin]) * self.inv[begin]
            ctx = self.mix(ctx ^ self.mix((before * 65536 + after).astype(U)))
            h = grams[at]
            # in a periodic text neighbours have equal contexts: such a run is one row
            same = (text[1:] == text[:-1]) & (h[1:] == h[:-1]) & (ctx[1:] == ctx[:-1])
            head = np.flatnonzero(np.r_[True, ~same])
            tail = np.r_[head[1:], len(pos)] - 1
            span, many = pos[tail] - pos[head], tail - head + 1
            h, ctx = h.view(np.int64), ctx.view(np.int64)
            yield *(x[head] for x in (text, pos, before, after, own, h, ctx)), span, many


@functools.lru_cache(maxsize=2)
def _anchors(length: int, piece: int) -> Anchors:
    return Anchors(length, piece)


def _anchor_rows(length: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _anchors(length, piece)
        names = ["id", "xh", "pos", "before", "after", "own", "h", "ctx", "run", "many"]
        for batch in batches:
            for text, *rest in maker.of(batch.column(2).to_pylist()):
                rows = pa.array(text)
                arrays = [batch.column(0).take(rows), batch.column(1).take(rows)]
                arrays += [pa.array(x.astype(np.int64)) for x in rest]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def reach(forward: list[bytes], backward: list[bytes], side: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the repeated strings around each suffix reach, backwards and forwards; -1 for none.

    Strings ``i`` and ``j`` share the window that starts ``o`` bytes before the minimiser if their
    backward prefix has ``o`` bytes or more and their forward one ``side - o``. All such windows of a
    string hold the minimiser, so their union is one run.
    """
    m = len(forward)
    f_order, f_lcp = deep_shallow_sort(forward)
    b_order, b_lcp = deep_shallow_sort(backward)
    if m <= DENSE:
        def matrix(order, lcp):
            x = np.where(np.tri(m, dtype=bool), 1 << 20, lcp[None, :])
            x = np.minimum.accumulate(x, axis=1)
            x = np.minimum(x, x.T)
            rank = np.empty(m, np.int64)
            rank[order] = np.arange(m)
            return x[rank][:, rank]
        f, b = matrix(f_order, f_lcp), matrix(b_order, b_lcp)
        same = f + b >= side
        np.fill_diagonal(same, False)
        return np.where(same, b, -1).max(axis=1), np.where(same, f, -1).max(axis=1)
    left, right = np.full(m, -1), np.full(m, -1)
    f_len = np.fromiter(map(len, forward), np.int64, m)
    b_len = np.fromiter(map(len, backward), np.int64, m)
    f_class, b_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(side + 1):
        f_class[f_order] = np.cumsum(f_lcp < side - o)
        b_class[b_order] = np.cumsum(b_lcp < o)
        ok = np.flatnonzero((b_len >= o) & (f_len >= side - o))
        if len(ok) < 2:
            continue
        key = f_class[ok] * (m + 1) + b_class[ok]
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        hit = ok[n[at] > 1]
        left[hit] = o
        right[hit] = np.maximum(right[hit], side - o)
    return left, right


def _reach_rows(length: int, piece: int):
    """Rows (h, ctx, before, bytes) sorted by h to (h, ctx, left, right)."""

    def groups(rows):
        out = []
        first = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]])
        for lo, hi in zip(first.tolist(), np.r_[first[1:], len(rows[0])].tolist()):
            before = rows[2][lo:hi].tolist()
            data = [x[b + piece :] for x, b in zip(rows[3][lo:hi], before)]
            back = [x[:b][::-1] for x, b in zip(rows[3][lo:hi], before)]
            if hi - lo > 1:
                left, right = reach(data, back, length - piece)
                hit = np.flatnonzero(left >= 0)
                out.append((rows[0][lo + hit], rows[1][lo + hit], left[hit], right[hit] + piece))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int64)) for c in columns], names=["h", "ctx", "left", "right"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = ctx = before = np.zeros(0, np.int64)
        data: list[bytes] = []
        for batch in batches:
            h = np.concatenate([h, batch.column(0).to_numpy()])
            ctx = np.concatenate([ctx, batch.column(1).to_numpy()])
            before = np.concatenate([before, batch.column(2).to_numpy()])
            data += batch.column(3).to_pylist()
            n = int(np.flatnonzero(h == h[-1])[0]) if len(h) else 0
            if n > 4096 or n and len(h) > LARGE_GROUP:
                yield groups((h[:n], ctx[:n], before[:n], data[:n]))
                h, ctx, before, data = h[n:], ctx[n:], before[n:], data[n:]
        if len(h):
            yield groups((h, ctx, before, data))

    return run


def _reach_large(rows: DataFrame, length: int) -> DataFrame:
    """The same for minimisers with too many contexts for one task.

    Every window that has this minimiser becomes a row, so a byte of text gives one row at most, and
    equal windows are counted with map-side sums: the group spreads over all tasks. Per window its
    offset and two hashes are compared.
    """
    offsets = F.sequence(
        F.greatest(F.floor(F.col("own") / 65536), length - F.octet_length("data") + F.col("before")),
        F.col("own") % 65536,
    )
    windows = rows.select("h", "ctx", "before", "data", F.explode(offsets).alias("o"))
    window = F.expr(f"substring(data, cast(before - o + 1 as int), {length})")
    windows = windows.select("h", "ctx", "o", F.xxhash64(window).alias("x"), F.unhex(F.md5(window)).alias("y"))
    same = windows.groupBy("h", "o", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    hits = windows.join(same, ["h", "o", "x", "y"], "left_semi")
    return hits.groupBy("h", "ctx").agg(
        F.max("o").cast("long").alias("left"), (length - F.min("o")).cast("long").alias("right")
    )


def repeated_spans(
    docs: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, piece: int = PIECE,
    large: int = LARGE_GROUP, by_word: bool = False,
) -> DataFrame:
    """``id, xh, spans`` per document with repeats: byte ranges ``[lo, hi)`` covered by repeats.

    With ``by_word`` a text is the string of its words' hashes, ``WORD`` bytes each, and ranges are in
    it. ``xh`` is the text's hash; together they name a document even if keys are null or repeated.
    """
    text_batches(docs.sparkSession)
    src = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("data"))
    data = word_string("data").alias("data") if by_word else F.col("data")
    src = src.select("id", F.xxhash64("data").alias("xh"), data)
    fields = [T.StructField(n, T.LongType()) for n in ("xh", "pos", "before", "after", "own", "h", "ctx", "run", "many")]
    schema = T.StructType([src.schema["id"], *fields])
    anchors, drop = scratch_table(src.mapInArrow(_anchor_rows(length, piece), schema), "anchors")
    # join sides are written first, so that adaptive execution can split the tasks of a hot minimiser
    often = anchors.groupBy("h").agg(F.sum("many").alias("n")).where("n > 1").select("h")
    often = materialise(often, "often")
    again = materialise(anchors.join(often, "h", "left_semi"), "anchors")
    drop()
    contexts = materialise(
        again.groupBy("h", "ctx").agg(
            F.sum("many").alias("n"), F.min(F.struct("xh", "pos", "id", "before", "after", "own")).alias("at")
        ),
        "contexts",
    )
    mixed = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    mixed = materialise(mixed, "mixed")
    wanted = (
        contexts.join(mixed, "h")
        .groupBy(F.col("at.id").alias("wid"), F.col("at.xh").alias("wxh"))
        .agg(F.collect_list(F.struct("h", "ctx", "m", "at.pos", "at.before", "at.after", "at.own")).alias("w"))
    )
    cut = F.expr("substring(data, cast(w.pos - w.before + 1 as int), cast(w.before + w.after as int))")
    # equal rows give a context more than once: as many equal strings, which n > 1 covers anyway
    strings = src.join(wanted, F.expr("id <=> wid AND xh = wxh"))
    strings = strings.select("data", F.explode("w").alias("w"))
    strings, drop = scratch_table(
        strings.select("w.h", "w.ctx", "w.before", "w.own", cut.alias("data"), "w.m"), "strings"
    )
    sorted_ = (
        strings.where(F.col("m") <= large).select("h", "ctx", "before", "data")
        .repartition("h").sortWithinPartitions("h", "ctx")
        .mapInArrow(_reach_rows(length, piece), "h long, ctx long, left long, right long")
    )
    hot = strings.where(F.col("m") > large).select("h", "ctx", "before", "own", "data")
    found = sorted_.unionByName(_reach_large(hot, length))
    covered = (
        contexts.join(found, ["h", "ctx"], "left")
        .select(
            "h", "ctx",
            F.when(F.col("n") > 1, F.col("at.before")).otherwise(F.col("left")).alias("left"),
            F.when(F.col("n") > 1, F.col("at.after")).otherwise(F.col("right")).alias("right"),
        )
        .where(F.col("left").isNotNull())
    )
    covered = materialise(covered, "covered")
    drop()
    span = F.struct((F.col("pos") - F.col("left")).alias("lo"), (F.col("pos") + F.col("run") + F.col("right")).alias("hi"))
    return (
        again.join(covered, ["h", "ctx"]).select("id", "xh", span.alias("span"))
        .groupBy("id", "xh").agg(F.collect_list("span").alias("spans"))
    )


@F.pandas_udf(T.BinaryType())
def word_string(data: pd.Series) -> pd.Series:
    """The hashes of a text's words one after another."""
    return pd.Series([word_hashes(d)[0].tobytes() for d in data], dtype=object)


def passage_words(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 51) -> DataFrame:
    """``id, xh, passage_words``: words in passages of ``words`` words or more that also start elsewhere.

    Rows without such passages are missing; ``id, xh`` are as in :func:`repeated_spans`.
    """

    @F.pandas_udf("long")
    def count(spans):
        return pd.Series([sum(b - a for a, b in _words_of(s)) for s in spans], dtype="int64")

    found = repeated_spans(docs, text, key, length=words * WORD, by_word=True)
    return found.select("id", "xh", count("spans").alias("passage_words"))


def _merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of possibly overlapping ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in (spans if spans is not None else ())):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _kept(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *[e for r in runs for e in r], len(data)]
    return b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _words_of(spans) -> list[tuple[int, int]]:
    """Ranges in a word string as ranges of whole words."""
    runs = [(-(-a // WORD), b // WORD) for a, b in _merged(spans)]
    return [(a, b) for a, b in runs if b > a]


def _with_spans(docs: DataFrame, text: str, key: str, **how) -> tuple[DataFrame, str, str]:
    """The rows with their text's bytes and repeated spans, and the names of these two columns."""
    i, x, spans, data = free_names(docs, "span_id", "span_hash", "spans", "data")
    found = repeated_spans(docs, text, key, **how)
    found = found.select(F.col("id").alias(i), F.col("xh").alias(x), F.col("spans").alias(spans))
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.withColumn(data, body)
    same = F.col(key).eqNullSafe(F.col(i)) & (F.xxhash64(data) == F.col(x))
    return rows.join(found, same, "left").drop(i, x), data, spans


def dedup_digest(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of every document.

    Every byte covered by a ``length``-byte string that also starts elsewhere in any document goes.
    Null text counts as empty; texts shorter than ``length`` keep all; equal rows repeat each other;
    an empty table gives an empty table; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        for batch in batches:
            rows = []
            for data, spans in zip(batch.column(1), batch.column(2)):
                data, runs = data.as_py(), _merged(spans.as_py())
                digest = hashlib.sha256(_kept(data, runs)).hexdigest()
                rows.append((len(data), sum(b - a for a, b in runs), len(runs), digest))
            n, removed, count, digest = zip(*rows) if rows else ((), (), (), ())
            arrays = [pa.array(x, pa.int64()) for x in (n, removed, count)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays, pa.array(digest, pa.string())], names=names
            )

    rows, data, spans = _with_spans(docs.select(key, text), text, key, **how)
    rows = rows.select(key, data, spans)
    schema = T.StructType(
        [rows.schema[key], *[T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")],
         T.StructField("kept_sha256", T.StringType())]
    )
    return rows.mapInArrow(run, schema)


def remove_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", length_column: str = "n_chars", words: int = 51, **how
) -> DataFrame:
    """The documents without passages of ``words`` words or more that also start elsewhere.

    Passages are compared word by word, whatever white space is between the words, and cut together
    with the white space around them; overlapping ones are one cut.
    Each of them repeats as a whole: shorter repeats side by side are left alone, however long they are
    together. ``length_column``, if there is one, follows the new text. No row is dropped; null and
    empty texts stay as they are, equal rows repeat each other.
    """

    @F.pandas_udf("string")
    def cut(data, spans):
        def one(d, s):
            _, starts, ends = word_hashes(d)
            starts, ends = [*starts.tolist(), len(d)], [0, *ends.tolist()]
            return _kept(d, [(ends[a], starts[b]) for a, b in _words_of(s)]).decode()

        return pd.Series([one(d, s) for d, s in zip(data, spans)], dtype=object)

    rows, data, spans = _with_spans(docs, text, key, length=words * WORD, by_word=True, **how)
    rows = rows.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(cut(data, spans)))
    if length_column in docs.columns:
        rows = rows.withColumn(length_column, F.length(text).cast(docs.schema[length_column].dataType))
    return rows.drop(data, spans)
