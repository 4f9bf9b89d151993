"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

STATE_DIM = 50
ACTION_DIM = 32

_floats = T.ArrayType(T.FloatType())
_bools = T.ArrayType(T.BooleanType())

FRAME = T.StructType(
    [
        T.StructField("episode_index", T.LongType()),
        T.StructField("frame_index", T.LongType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("embodiment", T.StringType()),
        T.StructField("proprio", _floats),
        T.StructField("action_native", _floats),
        T.StructField("action_canonical_ee", _floats),
        T.StructField("action_mask", _bools),
        T.StructField("state_mask", _bools),
        T.StructField("level_1", T.StringType()),
        T.StructField("level_2", T.StringType()),
        T.StructField("level_3", T.StringType()),
        T.StructField("subtask_label", T.BooleanType()),
    ]
)


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


MANIFEST_COLUMNS = {
    "episode_id": "string",
    "episode_idx": "long",
    "source": "string",
    "embodiment": "string",
    "raw_path": "string",
    "expected_n_frames": "long",
    "hash": "string",
}
LISTING_COLUMNS = {"path": "string", "length": "long", "modificationTime": "timestamp"}
LEDGER = ddl(
    {
        "source": "string",
        "stage": "string",
        "chunk": "long",
        "item": "string",
        "status": "string",
        "attempts": "int",
        "last_exit": "int",
        "updated_at": "double",
    }
)
TASKS = "task_index long, task string"
MODALITY_FIELD = (
    "map<string, struct<original_key:string, start:int, end:int, absolute:boolean, "
    "rotation_type:string, dtype:string, range:array<double>>>"
)
MODALITY = (
    f"state {MODALITY_FIELD}, action {MODALITY_FIELD}, "
    "video map<string, struct<original_key:string>>, "
    "annotation map<string, struct<original_key:string>>"
)
STATISTICS_ENTRY = (
    "struct<mean:array<double>, std:array<double>, min:array<double>, max:array<double>, "
    "q01:array<double>, q99:array<double>>"
)
INFO = (
    "codebase_version string, robot_type string, fps double, total_episodes long, "
    "total_frames long, total_tasks long, chunks_size long, data_path string, video_path string, "
    "features map<string, struct<dtype:string, shape:array<long>>>"
)
RULE = (
    "struct<kind:string, native_dim:int, ee_dim:int, indices:map<string,string>, "
    "scale:array<double>, bounds:map<string,array<double>>, fps:double>"
)
REGISTRY = f"version string, embodiments map<string, {RULE}>"
STATUSES = ("pending", "running", "done", "failed", "requeued")
