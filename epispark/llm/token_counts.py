"""Token counts of whole texts by rank-synchronous array merging."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark.llm.bpe import blocks, piece_model
from epispark.llm.words import text_batches

CACHE_WORDS = 200_000
CACHED_CHARS = 64


def _counter(model_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts = []
            for lo, hi in blocks(values := texts.to_pylist()):
                words = [model.pretokens(t or "") for t in values[lo:hi]]
                missing = list(set().union(*words) - known.keys())
                new = dict(zip(missing, model.encode_words(missing)[1].tolist()))
                known.update(new)
                counts += [sum(map(known.__getitem__, w)) for w in words]
                if len(known) > CACHE_WORDS:
                    known = {}
                elif new:
                    for w in [w for w in new if len(w) > CACHED_CHARS]:
                        del known[w]
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], size, pa.array(counts, pa.int64())],
                names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"],
            )

    return run


def count_tokens(
    docs: DataFrame,
    model_path: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    limit: int = 4096,
) -> DataFrame:
    """``keep`` columns with ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    Counts equal those of the SentencePiece library without begin and end ids. No shuffle: every
    partition is read once, distinct pre-tokens of about 2 M characters are merged together as ragged
    arrays and counted, and a bounded dictionary carries frequent ones to the next block.

    Null text counts as empty: 0 bytes, 0 tokens, ``over_limit`` false. Rows with null or repeated
    keys stay as they are, an empty table gives an empty table, other columns are not read. A very
    long text forms a block of its own.
    """
    text_batches(docs.sparkSession)
    src = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType(
        [*src.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    )
    out = src.mapInArrow(_counter(model_path), schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
