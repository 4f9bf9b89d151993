"""Vector columns (``array<double|float|boolean>``) as plain Column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL_DIM = 7
LINEAR_BOUND = 2.0
ANGULAR_BOUND = math.pi
# fixed values: lower and upper bound of each canonical action dimension
CANONICAL_LOW = [-LINEAR_BOUND] * 3 + [-ANGULAR_BOUND] * 3 + [0.0]
CANONICAL_HIGH = [LINEAR_BOUND] * 3 + [ANGULAR_BOUND] * 3 + [1.0]
# fixed values: width of a padded signal by the first name fragment it contains
KEY_WIDTHS = [
    ("eef_position", 3),
    ("eef_rotation", 3),
    ("arm", 7),
    ("left_hand", 6),
    ("right_hand", 6),
    ("waist", 3),
    ("gripper_width", 6),
]
DEFAULT_KEY_WIDTH = 63


def vec(*cols: Column) -> Column:
    return F.array(*cols)


def unpack(v: Column, n: int) -> list[Column]:
    """The first ``n`` elements as scalar columns (null past the end)."""
    return [F.get(v, F.lit(i)) for i in range(n)]


def zeros(n: int | Column, dtype: str = "double") -> Column:
    return F.array_repeat(F.lit(0).cast(dtype), n if isinstance(n, int) else n.cast("int"))


def falses(n: int | Column) -> Column:
    return F.array_repeat(F.lit(False), n if isinstance(n, int) else n.cast("int"))


def fit(v: Column, n: int, dtype: str = "double") -> Column:
    """Truncate or zero-pad to exactly ``n`` elements."""
    return F.slice(F.concat(v, zeros(n, dtype)), 1, n)


def pad_with_mask(v: Column, mask: Column, n: int, dtype: str = "double") -> tuple[Column, Column]:
    """Zero-pad a vector and extend its mask with False; longer vectors stay as they are."""
    short = F.greatest(F.lit(n) - F.size(v), F.lit(0))
    return F.concat(v, zeros(short, dtype)), F.concat(mask, falses(short))


def key_width(key: str) -> int:
    return next((w for part, w in KEY_WIDTHS if part in key), DEFAULT_KEY_WIDTH)


def pad_for_key(v: Column, key: str, single_arm: bool = False) -> tuple[Column, Column]:
    """Vector at the width of its key and a mask that is True on the real dims of non-zero rows."""
    width = key_width(key)
    if single_arm and "right" in key:
        return zeros(width), falses(width)
    real = F.least(F.size(v), F.lit(width))
    fitted = fit(v, width)
    live = F.exists(fitted, lambda x: (x != 0) | F.isnan(x))
    mask = F.concat(F.array_repeat(F.lit(True), real), falses(F.lit(width) - real))
    return fitted, F.when(live, mask).otherwise(falses(width))


def logical_slice(v: Column, start: int | Column, end: int | Column) -> Column:
    """``[start, end)`` of a physical vector."""
    if isinstance(start, int) and isinstance(end, int):
        return F.slice(v, start + 1, end - start)
    return F.slice(v, start + 1, end - start)


def split(v: Column, dims: dict[str, int]) -> dict[str, Column]:
    """Named consecutive pieces of a vector; inverse of ``F.concat`` in the same order."""
    out, at = {}, 0
    for name, width in dims.items():
        out[name] = logical_slice(v, at, at + width)
        at += width
    return out


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """Clamp that keeps NaN and null."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(F.isnan(x) | x.isNull(), x).otherwise(F.least(F.greatest(x, low), high))


def clip_canonical(v: Column) -> Column:
    xs = unpack(v, CANONICAL_DIM)
    return vec(*[clip(x, lo, hi) for x, lo, hi in zip(xs, CANONICAL_LOW, CANONICAL_HIGH)])


def canonical_ok(v: Column, tolerance: float = 1e-4) -> Column:
    """Row validity: width 7, finite, every group inside its bounds."""
    checks = F.size(v) == CANONICAL_DIM
    for x, lo, hi in zip(unpack(v, CANONICAL_DIM), CANONICAL_LOW, CANONICAL_HIGH):
        checks = checks & ~F.isnan(x) & (x >= lo - tolerance) & (x <= hi + tolerance)
    return F.coalesce(checks, F.lit(False))


def floored_mod(x: Column, m: float) -> Column:
    return F.pmod(x, F.lit(m))


def wrap_angle(x: Column) -> Column:
    """Angle moved into ``[-pi, pi)``."""
    return floored_mod(x + math.pi, 2 * math.pi) - math.pi


def angular_diff(a: Column, b: Column) -> Column:
    return wrap_angle(a - b)


def select_and_scale(v: Column, indices: Sequence[int], scale: Sequence[float]) -> Column:
    return vec(*[F.get(v, F.lit(i)) * float(s) for i, s in zip(indices, scale)])


def first_seven(v: Column, scale: Sequence[float]) -> Column:
    """Scaled, clipped first seven dims; fewer dims are an error."""
    guarded = F.when(F.size(v) >= CANONICAL_DIM, v).otherwise(
        F.raise_error(F.lit("expected at least 7 action dims"))
    )
    return clip_canonical(select_and_scale(guarded, range(CANONICAL_DIM), scale))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """One minus cosine similarity with both norms floored at ``eps``."""
    return 1.0 - dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def sin_cos(v: Column) -> Column:
    return F.concat(F.transform(v, F.sin), F.transform(v, F.cos))


def map2(a: Column, b: Column, fn) -> Column:
    return F.zip_with(a, b, fn)


def mask_and(mask: Column, visible: Column) -> Column:
    """Value mask combined with a per-row visibility flag."""
    return F.transform(mask, lambda m: m & visible)


def reverse_channels(pixels: Column) -> Column:
    """Reverse the channel order of ``array<array<channel>>`` pixels."""
    return F.transform(pixels, F.reverse)


def to_millimetres(metres: Column, limit: int = 5000) -> Column:
    return F.least(F.greatest(metres * 1000, F.lit(0)), F.lit(limit)).cast("int")


def insert_zero_block(before: Column, after: Column, width: int = 63) -> Column:
    """Zero block between two pieces, used where a source has no hand signal."""
    return F.concat(before, zeros(width), after)
