"""Training-time perturbations; all draws are hashes, so a rerun gives the same values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from epispark.functions.ids import hash_uniform


def gaussian(*key: Column) -> Column:
    """Standard normal draw from two hash uniforms."""
    u = hash_uniform(*key, F.lit("r"))
    v = hash_uniform(*key, F.lit("phi"))
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)


def jitter(x: Column, lo: Column, hi: Column, std: float, seed: int, *key: Column) -> Column:
    """``x`` with Gaussian noise, clamped to ``lo`` and ``hi``."""
    return F.least(F.greatest(x + std * gaussian(F.lit(seed), *key), lo), hi)


def perturb(v: Column, std: float, seed: int, *key: Column, training: bool = True) -> Column:
    """Gaussian jitter per element, clamped to the vector's own range; off for negative ``std``.

    For vectors that are rows per element anyway :func:`jitter` draws the same values in compiled code.
    """
    if not training or std < 0:
        return v
    lo, hi = F.array_min(v), F.array_max(v)
    return F.transform(
        v,
        lambda x, i: jitter(x, lo, hi, std, seed, *key, i),
    )


def dropout(v: Column, p: float, seed: int, *key: Column, training: bool = True) -> Column:
    """The zero vector with probability ``p``; off outside training or for ``p`` near zero."""
    if not training or p <= 1e-9:
        return v
    zero = F.transform(v, lambda _: F.lit(0.0))
    return F.when(hash_uniform(F.lit(seed), *key) < p, zero).otherwise(v)
