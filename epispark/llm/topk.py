"""Exact top-k inner-product search by columnar branch-and-bound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384  # candidates of a block
QUERY_ROWS = 256  # queries of a chunk
DIMS = 8  # dimensions accumulated between two prunings
SEEDS = 256


def branch_and_bound(
    columns: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query: its position, ids and scores of its best ``k`` candidates in this block.

    ``columns`` holds the block vertically, a row per dimension. Dimensions go by falling mass; after
    each ``DIMS`` of them, a candidate whose partial score plus the most that the remaining masses
    allow (Cauchy-Schwarz) is below the k-th best lower bound leaves the arrays.
    """
    dims = len(columns)
    order = np.argsort(-(columns.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    columns, queries = np.ascontiguousarray(columns[order]), queries[:, order]
    cuts = list(range(0, dims, DIMS)) or [0]
    masses = (columns.astype(np.float64) ** 2)[::-1].cumsum(axis=0)[::-1] if dims else columns
    rest = [np.sqrt(masses[c + DIMS]) if c + DIMS < dims else np.zeros(len(ids)) for c in cuts]
    qmass = (queries.astype(np.float64) ** 2)[:, ::-1].cumsum(axis=1)[:, ::-1]
    seeds = np.unique(np.linspace(0, len(ids) - 1, min(SEEDS, len(ids))).astype(np.int64))
    seed_scores = queries @ columns[:, seeds]
    for n, q in enumerate(queries):
        at = np.flatnonzero(ids != own[n])
        first = seed_scores[n][ids[seeds] != own[n]]
        floor = np.partition(first, -k)[-k] if len(first) >= k else np.iinfo(np.int64).min
        score = np.zeros(len(at), np.int64)
        for c, r in zip(cuts, rest):
            score = score + q[c : c + DIMS] @ columns[c : c + DIMS][:, at]
            if c + DIMS >= dims or len(at) <= k:
                continue
            slack = np.sqrt(qmass[n, c + DIMS]) * r[at] * (1 + 1e-9) + 1
            low = np.partition(score - slack, -k)[-k]
            keep = score + slack >= max(float(floor), low)
            at, score = at[keep], score[keep]
        best = np.lexsort((ids[at], -score))[:k]
        yield n, ids[at[best]], score[best]


def _search(k: int):
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def flat(batch: pa.RecordBatch, lo: int, hi: int):
        part = batch.slice(lo, hi - lo)
        ids = part.column(2).flatten().to_numpy().astype(np.int64)
        values = part.column(3).flatten().to_numpy().astype(np.int64)
        return ids, values.reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, columns, ids = None, [], None, None
        for batch in batches:
            p, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((p[1:] != p[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(p)]):
                if p[lo] != block:
                    block, held, columns = p[lo], [], None
                if kind[lo] == 0:
                    held.append(flat(batch, lo, hi))
                    continue
                if not held and columns is None:
                    continue
                if columns is None:
                    ids = np.concatenate([h[0] for h in held])
                    columns = np.ascontiguousarray(np.concatenate([h[1] for h in held]).T)
                    held = []
                own, queries = flat(batch, lo, hi)
                rows = [(own[n], i, s) for n, i, s in branch_and_bound(columns, ids, queries, own, k)]
                count = [len(i) for _, i, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([q for q, _, _ in rows], count), pa.int64()),
                        pa.array(np.concatenate([i for _, i, _ in rows]), pa.int64()),
                        pa.array(np.concatenate([s for _, _, s in rows]), pa.int64()),
                    ],
                    schema=out,
                )

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 1024,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` highest integer inner products of each query.

    Components become ``floor(scale * x)``. Ties go to the smaller key; rows with the query's own key
    are no candidates. Candidates stay in blocks of about ``block_rows`` rows, dealt evenly whatever
    their keys; packed chunks of queries are sent to every block, and a task holds one block and one
    chunk at a time. Each block answers with ``k`` rows a query at most, which are then ranked.

    Null keys or vectors, and vectors with null or non-finite components, take no part. Shorter
    vectors count as padded with zeros. Repeated rows are candidates each; equal queries count once.
    An empty table or no query gives an empty result. Scaled components must stay below 2**28.
    """
    fine = F.col(key).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = vectors.where(fine).select(
        F.col(key).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"),
        is_query.alias("q"),
    )
    total, width, n_queries = rows.agg(
        F.count(F.lit(1)), F.max(F.size("v")), F.sum(F.col("q").cast("int"))
    ).first()
    parts, chunks, width = -(-(total or 1) // block_rows), -(-(n_queries or 1) // QUERY_ROWS), width or 0
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    rows = rows.withColumn("v", padded)
    deal = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")
    candidates = rows.select(
        deal.alias("p"), F.lit(0).alias("kind"), F.array("id").alias("ids"), F.col("v").alias("flat")
    )
    packed = (
        rows.where("q").select("id", "v").distinct()
        .withColumn("c", F.pmod(F.xxhash64("id", "v"), F.lit(chunks)))
        .groupBy("c").agg(F.collect_list(F.struct("id", "v")).alias("s"))
    )
    chunks_everywhere = packed.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"),
        F.lit(1).alias("kind"),
        F.col("s.id").alias("ids"),
        F.flatten("s.v").alias("flat"),
    )
    dealt = candidates.unionByName(chunks_everywhere).repartition(parts, "p")
    found = dealt.sortWithinPartitions("p", "kind").mapInArrow(
        _search(k), "query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
