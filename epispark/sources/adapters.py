"""Raw-source adapters: each turns its raw table into the common frame schema.

A new source subclasses :class:`SourceAdapter`; conversions are pure, deterministic plans.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark import schemas
from epispark.functions import text as X
from epispark.functions import vectors as V
from epispark.operators.joins import promote_segments, resolve_instruction
from epispark.operators.windows import boundary_flag, finite_difference
from epispark.sources.readers import list_files, manifest, relative_path

# fixed values: embodiment name and frame rate of each source
EMBODIMENTS = {
    "arm_velocity": ("droid_franka", 15),
    "delta_pose": ("bridge_widowx", 5),
    "bimanual_segments": ("agibot_g1", 30),
    "joint_position": ("robomind_tien_kung", 25),
}

CANON = ["c0", "c1", "c2", "c3", "c4", "c5"]


def _pad(v: Column, n: int) -> Column:
    return V.fit(v.cast("array<float>"), n, "float")


def _mask(real: Column | int, n: int) -> Column:
    real = F.lit(real) if isinstance(real, int) else F.least(real, F.lit(n))
    return F.concat(F.array_repeat(F.lit(True), real), V.falses(F.lit(n) - real))


class SourceAdapter(ABC):
    """List raw episodes and convert raw rows to frames."""

    name: str
    pattern: str

    @property
    def embodiment(self) -> str:
        return EMBODIMENTS[self.name][0]

    @property
    def fps(self) -> float:
        return EMBODIMENTS[self.name][1]

    def list(self, spark: SparkSession, root: str) -> DataFrame:
        files = list_files(spark, root, self.pattern)
        return manifest(files, self.name, self.embodiment, relative_path(F.col("path"), root))

    @abstractmethod
    def to_frames(self, raw: DataFrame) -> DataFrame:
        """Raw rows to the frame schema."""

    def frame(self, df: DataFrame, **cols: Column) -> DataFrame:
        empty = F.lit("")
        base = {
            "timestamp": F.col("frame_index") / F.lit(float(self.fps)),
            "embodiment": F.lit(self.embodiment),
            "level_1": empty,
            "level_2": empty,
            "level_3": empty,
            "subtask_label": F.lit(False),
        }
        base.update(cols)
        picked = [
            (base[f.name] if f.name in base else F.col(f.name)).cast(f.dataType).alias(f.name)
            for f in schemas.FRAME
        ]
        return df.select(*picked)


class ArmVelocityAdapter(SourceAdapter):
    """Step records with joint, gripper and cartesian state and a 7-dim velocity action.

    Raw rows: ``episode_index, episode_id, steps array<struct<observation, action,
    language_instruction binary>>``; ``clean`` maps episode ids to cleaned instructions.
    """

    name, pattern = "arm_velocity", "*.tfrecord*"

    def __init__(self, clean: DataFrame | None = None):
        self.clean = clean

    def to_frames(self, raw: DataFrame) -> DataFrame:
        first = F.get("steps", F.lit(0))["language_instruction"]
        rows = raw.withColumn("raw_text", F.coalesce(X.decode_text(first), F.lit("")))
        if self.clean is None:
            rows = rows.withColumn("instruction", F.col("raw_text"))
        else:
            rows = resolve_instruction(rows, self.clean, "episode_id", "raw_text", "instruction")
        steps = numbered_steps(rows, "instruction")
        o = "s.observation."
        state = F.concat(o + "joint_position", o + "gripper_position", o + "cartesian_position")
        action = F.slice("s.action", 1, 7)
        return self.frame(
            steps,
            proprio=_pad(state, schemas.STATE_DIM),
            state_mask=_mask(F.size(state), schemas.STATE_DIM),
            action_native=_pad(action, schemas.ACTION_DIM),
            action_mask=_mask(7, schemas.ACTION_DIM),
            action_canonical_ee=V.select_and_scale(action, range(7), [1.0] * 7),
            level_1=F.col("instruction"),
        )


def numbered_steps(raw: DataFrame, *keep: str) -> DataFrame:
    """One row per step with its frame number in the episode.

    A long episode arrives as several records; ``first_frame`` then tells where a record begins.
    """
    first = F.col("first_frame") if "first_frame" in raw.columns else F.lit(0)
    rows = raw.select(
        "episode_index", *keep, first.alias("__first"), F.posexplode("steps").alias("__at", "s")
    )
    number = (F.col("__first") + F.col("__at")).cast("int")
    return rows.withColumn("frame_index", number).drop("__first", "__at")


def flat_action(flat: Column, parts: Column) -> Column:
    """Action given flat, or as a struct of world vector, rotation delta and a gripper under one of
    two names; the first gripper value is used and a missing one is 0."""
    zero3 = F.array(*[F.lit(0.0)] * 3)
    grip = F.coalesce(
        F.get(parts["open_gripper"], F.lit(0)),
        F.get(parts["gripper_closedness_action"], F.lit(0)),
        F.lit(0.0),
    )
    merged = F.concat(
        F.slice(F.coalesce(parts["world_vector"], zero3), 1, 3),
        F.slice(F.coalesce(parts["rotation_delta"], zero3), 1, 3),
        F.array(grip),
    )
    return F.coalesce(F.slice(flat, 1, 7), merged)


class DeltaPoseAdapter(SourceAdapter):
    """Step records with a pose-delta action (flat or struct), clipped to the canonical bounds.

    Raw rows: ``episode_index, steps array<struct<action_flat, action_parts, state,
    language_instruction string, natural_language_instruction string>>``.
    """

    name, pattern = "delta_pose", "*.tfrecord*"

    def to_frames(self, raw: DataFrame) -> DataFrame:
        first = F.get("steps", F.lit(0))
        spoken = F.coalesce(
            first["language_instruction"], first["natural_language_instruction"], F.lit("")
        )
        steps = numbered_steps(raw.withColumn("instruction", spoken), "instruction")
        raw_action = flat_action(F.col("s.action_flat"), F.col("s.action_parts"))
        steps = steps.withColumn("a", V.clip_canonical(raw_action))
        state = F.coalesce("s.state", V.zeros(7))
        return self.frame(
            steps,
            proprio=_pad(state, schemas.STATE_DIM),
            state_mask=_mask(F.size(state), schemas.STATE_DIM),
            action_native=_pad(F.col("a"), schemas.ACTION_DIM),
            action_mask=_mask(7, schemas.ACTION_DIM),
            action_canonical_ee=F.col("a"),
            level_1=F.col("instruction"),
        )


def velocity_from_pose(
    df: DataFrame, pose: Column, fps: float, key: str = "episode_index"
) -> DataFrame:
    """Clipped canonical velocity ``ee`` from a 7-dim pose column (zeros where it is absent)."""
    xs = {c: F.coalesce(F.get(pose, F.lit(i)), F.lit(0.0)) for i, c in enumerate(CANON)}
    rows = df.withColumns(
        {**xs, "c6": F.coalesce(F.get(pose, F.lit(6)), F.lit(0.0))}
    )
    rows = finite_difference(rows, [key], "frame_index", CANON[:3], CANON[3:], fps)
    canon = V.clip_canonical(F.array(*[f"v_{c}" for c in CANON], "c6"))
    return rows.withColumn("ee", canon).drop(*CANON, "c6", *[f"v_{c}" for c in CANON])


def prefixed_action(native: Column, limit: int | None = None) -> tuple[Column, Column]:
    """Canonical velocity in the first seven slots, native action behind it (at most 25 kept)."""
    room = schemas.ACTION_DIM - 7
    kept = F.slice(native, 1, min(limit or room, room))
    full = F.concat(F.col("ee"), kept)
    return _pad(full, schemas.ACTION_DIM), _mask(F.size(full), schemas.ACTION_DIM)


class BimanualSegmentAdapter(SourceAdapter):
    """Frame table with instruction segments; the right-arm pose sits at state slots 14..20.

    Raw rows: ``episode_index, frame_index, timestamp, task, state, action, segments`` where the
    segments (JSON text) are read from frame 0.
    """

    name, pattern = "bimanual_segments", "*.parquet"
    native_dim = 24

    def to_frames(self, raw: DataFrame) -> DataFrame:
        pose = F.when(F.size("state") >= 21, F.slice("state", 15, 7))
        rows = velocity_from_pose(raw, pose, self.fps)
        head = raw.where(F.col("frame_index") == 0).select(
            "episode_index",
            F.coalesce("task", F.lit("")).alias("task"),
            X.parse_segments(F.col("segments")).alias("segments"),
        )
        rows = promote_segments(
            rows.drop("task", "segments"), head, "episode_index", "frame_index", "task", "segments"
        )
        rows = boundary_flag(rows, ["episode_index"], "frame_index", "level_2", "subtask_label")
        native, mask = prefixed_action(F.coalesce("action", V.zeros(24)), self.native_dim)
        return self.frame(
            rows,
            timestamp=F.coalesce("timestamp", F.col("frame_index") / F.lit(float(self.fps))),
            proprio=_pad(F.coalesce("state", V.zeros(50)), schemas.STATE_DIM),
            state_mask=_mask(F.coalesce(F.size("state"), F.lit(50)), schemas.STATE_DIM),
            action_native=native,
            action_mask=mask,
            action_canonical_ee=F.slice(native, 1, 7),
            level_1=F.col("level_1"),
            level_2=F.col("level_2"),
            level_3=F.col("level_3"),
            subtask_label=F.col("subtask_label"),
        )


def coalesce_layouts(raw: DataFrame) -> DataFrame:
    """Two trajectory layouts to one: actions from ``actions`` or the leading arm, joints from the
    observations or the following arm, language under two names."""
    text = F.coalesce(
        X.decode_text(F.col("language_instruction")), X.decode_text(F.col("language_raw")), F.lit("")
    )
    return raw.select(
        "episode_id",
        "frame_index",
        F.coalesce("actions", "master.joint_position").alias("action"),
        F.coalesce("observations.joint_position", "puppet.joint_position").alias("joints"),
        F.col("observations.ee_pose").alias("ee_pose"),
        text.alias("instruction"),
    )


class JointPositionAdapter(SourceAdapter):
    """Joint-position trajectories in either layout; the end-effector pose is optional.

    Raw rows as :func:`coalesce_layouts` takes them, one per frame; the episode number is derived
    from the id's hash.
    """

    name, pattern = "joint_position", "*.h5"

    def to_frames(self, raw: DataFrame) -> DataFrame:
        from epispark.functions.ids import id_from_hash

        rows = coalesce_layouts(raw).withColumn(
            # the number comes from the 12-digit hash of the id
            "episode_index", id_from_hash(F.col("episode_id"))
        )
        # two ids may share a number, so frames follow one another within an id
        rows = velocity_from_pose(rows, F.col("ee_pose"), self.fps, "episode_id")
        native, mask = prefixed_action(F.col("action"))
        joints = F.coalesce("joints", V.zeros(14))
        return self.frame(
            rows,
            proprio=_pad(joints, schemas.STATE_DIM),
            state_mask=_mask(F.size(joints), schemas.STATE_DIM),
            action_native=native,
            action_mask=mask,
            action_canonical_ee=F.slice(native, 1, 7),
            level_1=F.col("instruction"),
        )


ADAPTERS: dict[str, type[SourceAdapter]] = {
    a.name: a
    for a in (ArmVelocityAdapter, DeltaPoseAdapter, BimanualSegmentAdapter, JointPositionAdapter)
}


def enumerate_source(
    spark: SparkSession, name: str, root: str, enumerator=None
) -> DataFrame:
    """Manifest of a registered source, or of a caller-supplied enumerator."""
    return enumerator(spark, root) if enumerator else ADAPTERS[name]().list(spark, root)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Frames of several sources in one schema, missing columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
