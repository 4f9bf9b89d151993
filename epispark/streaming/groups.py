"""Group-wise functions over sorted partitions, one Arrow stream per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from epispark.scale import in_key_order


def split_groups(
    batches: Iterator[pd.DataFrame], keys: Sequence[str]
) -> Iterator[pd.DataFrame]:
    """Complete groups of a stream sorted by ``keys``; only the open group is held back."""
    rest: pd.DataFrame | None = None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        ids = pdf[list(keys)]
        cuts = np.flatnonzero((ids != ids.shift()).any(axis=1).to_numpy()[1:]) + 1
        bounds = [0, *cuts.tolist(), len(pdf)]
        for lo, hi in zip(bounds[:-2], bounds[1:-1]):
            yield pdf.iloc[lo:hi]
        rest = pdf.iloc[bounds[-2] :]
    if rest is not None:
        yield rest


def map_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    batch_rows: int = 20_000,
) -> DataFrame:
    """Apply ``fn`` to each bounded group.

    Spark hash-partitions and sorts; a task streams its groups through one Python worker and returns
    them in large batches, which avoids a round trip per small group.
    """

    def run(batches):
        out, n = [], 0
        for group in split_groups(batches, keys):
            res = fn(group)
            out.append(res)
            n += len(res)
            if n >= batch_rows:
                yield pd.concat(out, ignore_index=True)
                out, n = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return in_key_order(df, keys, *order).mapInPandas(run, schema)
