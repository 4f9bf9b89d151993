"""Queries in the form that their plans take on large tables, held against the same oracles.

Tables above ``scale.ROWS_PER_BUCKET`` rows are filled and ranked in two levels, and numbered so where a key
has more than ``scale.ROWS_PER_KEY``. Here the limit is 1,000 rows while the plan is built, whatever the
longest key, so the test data already take that way.
"""

from __future__ import annotations

from epispark import scale
from epispark.plans.registry import REGISTRY, query

NAMES = (
    "win01_finite_difference", "win16_dense_manifest_index", "jn04_asof_nearest",
    "jn05_asof_backward", "agg01_vector_statistics", "win19_hold_last_frame",
)


def _build(name: str):
    def build(spark, sf):
        limits = scale.ROWS_PER_BUCKET, scale.ROWS_PER_KEY
        scale.ROWS_PER_BUCKET, scale.ROWS_PER_KEY = 1_000, 0
        try:
            return REGISTRY[name].build(spark, sf)
        finally:
            scale.ROWS_PER_BUCKET, scale.ROWS_PER_KEY = limits

    return build


for _name in NAMES:
    query(f"{_name}_large", " ".join(REGISTRY[_name].ids), REGISTRY[_name].oracle)(_build(_name))
