"""Normalisation of one value against its dimension's statistics, and of whole vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from epispark.functions.vectors import clip

MODES = ("q99", "mean_std", "min_max", "scale", "binary")
INVERTIBLE = ("q99", "mean_std", "min_max", "binary")


def _span(x: Column, lo: Column, hi: Column) -> Column:
    return 2 * ((x - lo) / (hi - lo)) - 1


def forward(x: Column, s, mode: str) -> Column:
    """Normalise ``x``; ``s`` maps mean/std/min/max/q01/q99 to columns (dict or struct).

    A dimension without spread passes through (q99, mean_std) or becomes 0 (min_max, scale);
    q99 clamps the result in every case.
    """
    if mode == "q99":
        lo, hi = s["q01"], s["q99"]
        return clip(F.when(lo != hi, _span(x, lo, hi)).otherwise(x), -1.0, 1.0)
    if mode == "mean_std":
        return F.when(s["std"] != 0, (x - s["mean"]) / s["std"]).otherwise(x)
    if mode == "min_max":
        lo, hi = s["min"], s["max"]
        return F.when(lo != hi, _span(x, lo, hi)).otherwise(F.lit(0.0))
    if mode == "scale":
        top = F.greatest(F.abs(s["min"]), F.abs(s["max"]))
        return F.when(top != 0, x / top).otherwise(F.lit(0.0))
    if mode == "binary":
        return (x > 0.5).cast("double")
    raise ValueError(f"unknown normalisation mode: {mode}")


def inverse(x: Column, s, mode: str) -> Column:
    if mode == "q99":
        return (x + 1) / 2 * (s["q99"] - s["q01"]) + s["q01"]
    if mode == "mean_std":
        return x * s["std"] + s["mean"]
    if mode == "min_max":
        return (x + 1) / 2 * (s["max"] - s["min"]) + s["min"]
    if mode == "binary":
        return (x > 0.5).cast("double")
    raise ValueError(f"mode has no inverse: {mode}")


def _each(v: Column, stats: Column, width: int | None, fn) -> Column:
    """Element-wise: unrolled into generated code for a known width, else a higher-order function."""
    if width is None:
        return F.zip_with(v, stats, fn)
    at = [(F.get(v, F.lit(i)), F.get(stats, F.lit(i))) for i in range(width)]
    return F.array(*[fn(x, s) for x, s in at])


def forward_vector(v: Column, stats: Column, mode: str, width: int | None = None) -> Column:
    """Vector form; ``stats`` is ``array<struct<mean,std,min,max,q01,q99>>`` by dimension."""
    return _each(v, stats, width, lambda x, s: forward(x, s, mode))


def inverse_vector(v: Column, stats: Column, mode: str, width: int | None = None) -> Column:
    return _each(v, stats, width, lambda x, s: inverse(x, s, mode))


def _mapped(x: Column, lo: Column, hi: Column) -> Column:
    return 0.5 * (x + 1) * (hi - lo) + lo


def policy_unnormalise(
    v: Column, lo: Column, hi: Column, mask: Column, binary_dim: int | None = None
) -> Column:
    """Clamp to +-1, threshold one channel at 0.5, rescale the masked-in dimensions."""

    def one(x: Column, i: Column) -> Column:
        y = clip(x, -1.0, 1.0)
        if binary_dim is not None:
            y = F.when(i == binary_dim, (y >= 0.5).cast("double")).otherwise(y)
        return F.when(F.get(mask, i), _mapped(y, F.get(lo, i), F.get(hi, i))).otherwise(y)

    return F.transform(v, one)


def state_normalise(x: Column, lo: Column, hi: Column, eps: float = 1e-8) -> Column:
    """Min/max scaling clamped to +-1 with a guarded denominator; constant dims become 0."""
    scaled = clip((x - lo) / (hi - lo + eps) * 2 - 1, -1.0, 1.0)
    return F.when(hi == lo, F.lit(0.0)).otherwise(scaled)
