"""SentencePiece encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.bpe import blocks, piece_model
from epispark.llm.words import text_batches

CACHE_WORDS = 150_000
CACHED_CHARS = 64
#: Texts are encoded in blocks of so many characters, one text at least: symbol arrays are many times as large.
BLOCK_CHARS = 1 << 18


def _encoder(model_path: str, ends: bool, finish):
    """Batches of (kept columns..., text) to (kept columns..., what ``finish`` makes of the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        begin = np.array([model.begin], "<u4").tobytes() if ends else b""
        end = np.array([model.end], "<u4").tobytes() if ends else b""
        known: dict[str, bytes] = {}
        for batch in batches:
            values = batch.column(batch.num_columns - 1).to_pylist()
            for lo, hi in blocks(values, BLOCK_CHARS):
                words = [model.pretokens(t or "") for t in values[lo:hi]]
                missing = list(set().union(*words) - known.keys())
                ids, counts = model.encode_words(missing)
                raw, stops = ids.astype("<u4").tobytes(), np.cumsum(counts) * 4
                new = zip(missing, (stops - counts * 4).tolist(), stops.tolist())
                known.update((w, raw[a:b]) for w, a, b in new)
                rows = [begin + b"".join(map(known.__getitem__, w)) + end for w in words]
                if len(known) > CACHE_WORDS:
                    known = {}
                else:
                    for w in [w for w in missing if len(w) > CACHED_CHARS]:
                        del known[w]
                kept = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                made = finish(model, rows)
                yield pa.RecordBatch.from_arrays(
                    [*kept, *made.values()], names=[*batch.schema.names[:-1], *made]
                )

    return run


def _ids(model, rows: list[bytes]) -> dict[str, pa.Array]:
    stops = np.cumsum([0, *map(len, rows)]) // 4
    flat = np.frombuffer(b"".join(rows), "<u4").astype(np.int32)
    return {"ids": pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat))}


def _digests(model, rows: list[bytes]) -> dict[str, pa.Array]:
    decoded = [model.decode(np.frombuffer(r, "<u4").astype(np.int64)) for r in rows]
    return {
        "n_tokens": pa.array([len(r) // 4 for r in rows], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in rows]),
        "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
    }


def _source(docs: DataFrame, text: str, keep: Sequence[str]) -> tuple[DataFrame, list[T.StructField]]:
    text_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    return src, src.schema.fields[:-1]


def encode(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    ends: bool = True,
) -> DataFrame:
    """``keep`` columns and ``ids``, an array of int, of every whole text.

    Ids equal those of the SentencePiece library, with begin and end ids if ``ends``. No shuffle.
    Null text counts as empty (only the end ids); null or repeated keys pass through; an empty table
    gives an empty table; columns that are not kept are not read.
    """
    src, fields = _source(docs, text, keep)
    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(_encoder(model_path, ends, _ids), schema)


def decode(
    encoded: DataFrame, model_path: str, ids: str = "ids", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns and the decoded ``text`` of every id array; null ids decode to null.

    Byte ids are joined and read as UTF-8; begin and end ids give nothing; the dummy prefix goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            rows = batch.column(batch.num_columns - 1)
            texts = [None if not r.is_valid else model.decode(r.values.to_numpy()) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string())],
                names=[*batch.schema.names[:-1], "text"],
            )

    src = encoded.select(*keep, F.col(ids).alias("__ids"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("text", T.StringType())])
    return src.mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, model_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """``keep`` columns with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every text.

    Encodes with begin and end ids and decodes these ids again in one pass over the partition; edge
    cases are those of :func:`encode`.
    """
    src, fields = _source(docs, text, keep)
    names = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in names.items()]])
    return src.mapInArrow(_encoder(model_path, True, _digests), schema)
