"""Transform contract: small objects that map a DataFrame to a DataFrame with Column expressions.

``apply`` runs forward, ``unapply`` the inverse where there is one; :class:`Compose` chains them and
un-applies in reverse order. ``train``/``eval`` switch the random ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.functions import augment, normalise
from epispark.functions import vectors as V
from epispark.functions.rotation import convert_rotation
from epispark.operators.joins import attach_rule
from epispark.operators.windows import finite_difference, gather_offsets


class Transform:
    training = True

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def unapply(self, df: DataFrame) -> DataFrame:
        raise TypeError(f"{type(self).__name__} has no inverse")

    def train(self) -> Transform:
        self.training = True
        return self

    def eval(self) -> Transform:
        self.training = False
        return self


class Compose(Transform):
    def __init__(self, parts: Sequence[Transform]):
        self.parts = list(parts)

    def apply(self, df: DataFrame) -> DataFrame:
        for p in self.parts:
            df = df.transform(p.apply)
        return df

    def unapply(self, df: DataFrame) -> DataFrame:
        for p in reversed(self.parts):
            df = df.transform(p.unapply)
        return df

    def train(self) -> Transform:
        for p in self.parts:
            p.train()
        return self

    def eval(self) -> Transform:
        for p in self.parts:
            p.eval()
        return self


class Normalise(Transform):
    """Normalise one vector column; ``stats`` is a column of per-dimension statistics."""

    def __init__(self, column: str, mode: str, stats: Column):
        if mode not in normalise.MODES:
            raise ValueError(f"unknown normalisation mode: {mode}")
        self.column, self.mode, self.stats = column, mode, stats

    def apply(self, df: DataFrame) -> DataFrame:
        out = normalise.forward_vector(F.col(self.column), self.stats, self.mode)
        return df.withColumn(self.column, out)

    def unapply(self, df: DataFrame) -> DataFrame:
        out = normalise.inverse_vector(F.col(self.column), self.stats, self.mode)
        return df.withColumn(self.column, out)


class Concat(Transform):
    """Join vector columns in declared order into one; the inverse splits it again."""

    def __init__(self, target: str, dims: dict[str, int]):
        self.target, self.dims = target, dims

    def apply(self, df: DataFrame) -> DataFrame:
        checked = [
            F.when(F.size(c) == n, F.col(c)).otherwise(
                F.raise_error(F.lit(f"{c} must have {n} dims"))
            )
            for c, n in self.dims.items()
        ]
        return df.withColumn(self.target, F.concat(*checked)).drop(*self.dims)

    def unapply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(V.split(F.col(self.target), self.dims)).drop(self.target)


class Rotate(Transform):
    """Change of rotation representation, both ways."""

    def __init__(self, column: str, source: str, target: str):
        self.column, self.source, self.target = column, source, target

    def apply(self, df: DataFrame) -> DataFrame:
        out = convert_rotation(F.col(self.column), self.source, self.target)
        return df.withColumn(self.column, out)

    def unapply(self, df: DataFrame) -> DataFrame:
        out = convert_rotation(F.col(self.column), self.target, self.source)
        return df.withColumn(self.column, out)


class SinCos(Transform):
    def __init__(self, column: str):
        self.column = column

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.column, V.sin_cos(F.col(self.column)))


class Perturb(Transform):
    def __init__(self, column: str, std: float, seed: int, *key: str):
        self.column, self.std, self.seed, self.key = column, std, seed, key

    def apply(self, df: DataFrame) -> DataFrame:
        cols = [F.col(k) for k in self.key]
        out = augment.perturb(
            F.col(self.column), self.std, self.seed, *cols, training=self.training
        )
        return df.withColumn(self.column, out)


class Dropout(Transform):
    def __init__(self, column: str, p: float, seed: int, *key: str):
        self.column, self.p, self.seed, self.key = column, p, seed, key

    def apply(self, df: DataFrame) -> DataFrame:
        cols = [F.col(k) for k in self.key]
        out = augment.dropout(F.col(self.column), self.p, self.seed, *cols, training=self.training)
        return df.withColumn(self.column, out)


class StateAction(Transform):
    """Optional change of rotation representation followed by normalisation of one key.

    Rules: a converted rotation must be absolute and takes only min/max with known bounds; a relative
    one cannot be converted; a non-continuous signal takes only ``binary``.
    """

    def __init__(
        self, column: str, rotation: str | None = None, target_rotation: str | None = None,
        mode: str | None = None, stats: Column | None = None,
        bounds: tuple[float, float] | None = None, absolute: bool = True, continuous: bool = True,
    ):
        if target_rotation is not None:
            if rotation is None or not absolute:
                raise ValueError("only an absolute rotation can be converted")
            if mode not in (None, "min_max"):
                raise ValueError("a converted rotation takes min_max only")
            if mode == "min_max" and bounds is None:
                raise ValueError("a converted rotation needs known bounds")
        if not continuous and mode not in (None, "binary"):
            raise ValueError("a non-continuous signal takes binary only")
        if mode not in (None, "binary") and stats is None and bounds is None:
            raise ValueError("normalisation needs statistics or bounds")
        self.parts: list[Transform] = []
        if target_rotation is not None:
            self.parts.append(Rotate(column, rotation, target_rotation))
        if mode is not None:
            if stats is None and bounds is not None:
                entry = F.struct(F.lit(bounds[0]).alias("min"), F.lit(bounds[1]).alias("max"))
                stats = F.transform(F.col(column), lambda _: entry)
            elif stats is None:
                stats = F.transform(F.col(column), lambda _: F.struct(F.lit(0.0).alias("min")))
            self.parts.append(Normalise(column, mode, stats))

    def apply(self, df: DataFrame) -> DataFrame:
        return Compose(self.parts).apply(df)

    def unapply(self, df: DataFrame) -> DataFrame:
        return Compose(self.parts).unapply(df)


# rules from the selected action and its finite difference to the canonical action; users add more
RULES = {
    "ee_velocity_passthrough": lambda picked, diff, first, scale: _scaled(picked, scale),
    "ee_pose_finite_diff": lambda picked, diff, first, scale: V.clip_canonical(
        _scaled(diff, scale)
    ),
    "joint_position_to_ee_finite_diff": lambda picked, diff, first, scale: V.clip_canonical(
        _scaled(first, scale)
    ),
    "joint_delta_to_ee_finite_diff": lambda picked, diff, first, scale: V.clip_canonical(
        _scaled(first, scale)
    ),
}


def _scaled(v: Column, scale: Column) -> Column:
    at = range(V.CANONICAL_DIM)
    return F.array(*[F.get(v, F.lit(i)) * F.get(scale, F.lit(i)) for i in at])


def rule_arrays(rules: DataFrame) -> DataFrame:
    """Registry rows with their index maps as one array of seven positions, defaults filled in."""

    def ints(*names: str) -> Column:
        return F.coalesce(*[F.from_json(F.col("indices")[n], "array<int>") for n in names])

    order = F.concat(
        ints("linear_velocity_xyz", "ee_position_xyz"),
        ints("angular_velocity_xyz", "ee_rotvec_xyz"),
        F.array(F.col("indices")["gripper"].try_cast("int")),
    )
    plain = F.sequence(F.lit(0), F.lit(V.CANONICAL_DIM - 1))
    return rules.select(
        "embodiment",
        "kind",
        "native_dim",
        F.coalesce(order, plain).alias("order"),
        F.coalesce("scale", F.array_repeat(F.lit(1.0), V.CANONICAL_DIM)).alias("scale"),
        F.coalesce("fps", F.lit(10.0)).alias("fps"),
    )


def canonicalise(
    frames: DataFrame, rules: DataFrame, keys: Sequence[str], index: str, action: str,
    name: str = "action_canonical_ee",
) -> DataFrame:
    """Canonical 7-dim action of every frame by its embodiment's rule.

    ``rules`` comes from :func:`rule_arrays`. An unknown embodiment or kind, or fewer dims than the
    rule states, is an error. One window pass serves all rules.
    """
    rows = attach_rule(frames, rules)
    width = F.when(F.size(action) >= F.col("native_dim"), F.col(action)).otherwise(
        F.raise_error(F.lit("fewer action dims than the rule states"))
    )
    seven = range(V.CANONICAL_DIM)
    picks = {f"__x{i}": F.get(action, F.get("order", F.lit(i))).cast("double") for i in seven}
    rows = rows.withColumn(action, width).withColumns(picks)
    names = list(picks)
    rows = finite_difference(rows, keys, index, names[:3], names[3:6], 1.0, prefix="__v")
    picked = F.array(*names)
    diff = F.array(*[F.col(f"__v{c}") * F.col("fps") for c in names[:6]], names[6])
    out = F.raise_error(F.concat(F.lit("unknown rule "), "kind")).cast("array<double>")
    for kind, rule in RULES.items():
        out = F.when(
            F.col("kind") == kind, rule(picked, diff, F.col(action), F.col("scale"))
        ).otherwise(out)
    extra = [c for c in rules.columns if c != "embodiment"]
    return rows.withColumn(name, out).drop(*names, *[f"__v{c}" for c in names[:6]], *extra)


@dataclass(frozen=True)
class WindowConfig:
    """Which columns to gather at which offsets around every ``interval``-th frame.

    Defaults by signal: observations at -5 and 0, one future frame at 5, history -5..-1 and actions
    -5..16. ``plan`` gives one array and one mask column per (key, value).
    """

    values: dict[str, str]
    offsets: dict[str, Sequence[int]] = field(
        default_factory=lambda: {
            "observation": [-5, 0],
            "future": [5],
            "history": list(range(-5, 0)),
            "action": list(range(-5, 17)),
        }
    )
    interval: int = 3
    padding: str = "first_last"

    def plan(self, frames: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
        """All windows in one pass: the union of the offsets is gathered once and then sliced."""
        every = sorted({o for offs in self.offsets.values() for o in offs})
        cols = {name: F.col(c) for name, c in self.values.items()}
        all_rows = gather_offsets(
            frames, keys, index, {f"__{n}": c for n, c in cols.items()}, every, self.padding
        )
        rows = all_rows.where(F.col(index) % self.interval == 0)
        out = {}
        for key, offs in self.offsets.items():
            at = [every.index(o) for o in offs]
            for name in self.values:
                out[f"{key}_{name}"] = F.array(*[F.col(f"__{name}")[i] for i in at])
            out[f"{key}_mask"] = F.array(*[F.col("mask")[i] for i in at])
        return rows.withColumns(out).drop("mask", *[f"__{n}" for n in self.values])

    def extended(self, **changes) -> WindowConfig:
        """A derived configuration, e.g. of a robot that differs in a few entries."""
        from dataclasses import replace

        return replace(self, **changes)
