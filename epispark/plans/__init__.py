"""Registered queries, one module per area."""

from epispark.plans.registry import REGISTRY

from . import (  # noqa: F401
    q_windows,
    q_stats,
    q_joins,
    q_functions,
    q_sampling,
    q_ingest,
    q_streaming,
    q_large,
    q_deep,
)

__all__ = ["REGISTRY"]
