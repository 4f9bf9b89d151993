"""Reading, writing, resuming and streaming over files."""

from __future__ import annotations

import json
import tempfile

import pytest
from pyspark.sql import functions as F

from epispark.operators import quality as Q
from epispark.sources import adapters as AD
from epispark.sources import readers as RD
from epispark.sources import sinks as SK
from epispark.streaming import flows as FL
from epispark.streaming import trigger as TR


@pytest.fixture()
def root():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_listing_and_manifest(spark, root):
    for name in ("b/ep2.parquet", "a/ep1.parquet", "a/ep3.parquet"):
        spark.range(1).coalesce(1).write.parquet(f"{root}/raw/{name}")
    files = RD.list_files(spark, f"{root}/raw", "*.parquet")
    assert files.count() == 3 and set(files.columns) == {"path", "length", "modificationTime"}
    m = AD.BimanualSegmentAdapter().list(spark, f"{root}/raw").orderBy("episode_idx").collect()
    assert [r["episode_idx"] for r in m] == [0, 1, 2]
    assert [r["episode_id"].split("/")[1] for r in m] == ["ep1.parquet", "ep3.parquet", "ep2.parquet"]
    assert {r["embodiment"] for r in m} == {"agibot_g1"}
    assert RD.list_files(spark, f"{root}/missing").count() == 0


def test_episode_filter_reaches_the_scan(spark, root):
    spark.range(100).select(F.col("id").alias("episode_index"), F.rand().alias("x"), F.rand().alias("y")).write.parquet(f"{root}/f")
    df = RD.read_frames(spark, f"{root}/f", episode=7, columns=["episode_index", "x"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(episode_index,7)" in plan and "y:double" not in plan
    assert df.count() == 1


def test_read_metadata(spark, root):
    info = {"fps": 30, "chunks_size": 1000, "total_episodes": 4, "features": {"a": {"dtype": "float64", "shape": [7]}}}
    with open(f"{root}/info.json", "w") as f:
        json.dump(info, f, indent=2)
    row = RD.read_info(spark, f"{root}/info.json").first()
    assert row["fps"] == 30 and row["chunks_size"] == 1000 and row["features"]["a"]["shape"] == [7]
    doc = json.dumps({"state": {"arm": {"start": 0, "end": 7}}, "action": {"g": {"start": 7, "end": 8, "absolute": False}}})
    fields = RD.modality_fields(spark.createDataFrame([(doc,)], "d string"), "d")
    f = RD.field_of(fields, "action.g").first()
    assert (f["start"], f["end"], f["absolute"], f["original_key"]) == (7, 8, False, "action")
    assert RD.field_of(fields, "state.none").count() == 0


def test_statistics_with_a_missing_vector_are_recomputed(spark):
    entry = {k: [1.0, 2.0] for k in ("mean", "std", "min", "max", "q01", "q99")}
    doc = json.dumps({"ok": entry, "broken": {"mean": [1.0]}})
    rows = RD.statistics_rows(spark.createDataFrame([(doc,)], "d string"), "d")
    assert {(r["key"], r["dim"]) for r in rows.collect()} == {("ok", 0), ("ok", 1)}


def test_features_round_trip_and_ragged_error(spark, root):
    rows = [("head", "rgb", 0, e, i, [[float(e)] * 3] * 2) for e in (1, 2) for i in range(4)]
    schema = "camera string, modality string, chunk long, episode_index long, feat_idx long, tokens array<array<float>>"
    SK.write_features(spark.createDataFrame(rows, schema), f"{root}/feat")
    got = RD.read_features(spark, f"{root}/feat", "head", "rgb", 2, [0, 3])
    assert sorted(r["feat_idx"] for r in got.collect()) == [0, 3]
    bad = spark.createDataFrame([("h", "rgb", 0, 1, 0, [[1.0], [1.0, 2.0]])], schema)
    with pytest.raises(Exception):
        SK.write_features(bad, f"{root}/bad")


def test_frames_are_written_once(spark, root):
    frames = spark.range(40).select(
        F.lit("s").alias("source"), F.floor(F.col("id") / 20).alias("chunk"),
        F.floor(F.col("id") / 4).alias("episode_index"), (F.col("id") % 4).alias("frame_index"))
    out, ledger = f"{root}/out", f"{root}/ledger"
    SK.write_frames(frames.where("chunk = 0"), out, ledger)
    before = {f for f in spark.read.parquet(out).inputFiles()}
    SK.write_frames(frames, out, ledger)
    SK.write_frames(frames, out, ledger)
    assert before <= set(spark.read.parquet(out).inputFiles())
    back = spark.read.parquet(out)
    assert back.count() == 40 and Q.loss_and_duplicates(
        frames.withColumn("k", F.col("episode_index") * 10 + F.col("frame_index")),
        back.withColumn("k", F.col("episode_index") * 10 + F.col("frame_index")), "k").count() == 0


def test_quarantine_of_missing_columns(spark):
    rep = Q.table_report(spark.range(3), ["id", "x"], F.lit("f")).first()
    assert rep["ok"] is False and rep["errors"] == ["missing column: x"]


def test_ingest_resumes_without_loss(spark, root):
    src, schema = f"{root}/src", "source string, episode_index long"
    make = lambda lo, hi: spark.range(lo, hi).select(F.lit("s").alias("source"), F.col("id").alias("episode_index"))
    make(0, 3).repartition(1).write.mode("append").parquet(src)
    stream = lambda: FL.file_stream(spark, src, schema, files_per_trigger=1)
    calls = []

    def stop_midway(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("preempted")
        return df

    FL.ingest(stream(), stop_midway, f"{root}/out", f"{root}/ledger", f"{root}/ckpt")
    make(3, 5).repartition(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="preempted"):
        FL.ingest(stream(), stop_midway, f"{root}/out", f"{root}/ledger", f"{root}/ckpt")
    FL.ingest(stream(), lambda df: df, f"{root}/out", f"{root}/ledger", f"{root}/ckpt")
    ids = sorted(r["episode_index"] for r in spark.read.parquet(f"{root}/out").collect())
    assert ids == [0, 1, 2, 3, 4]
    done = spark.read.parquet(f"{root}/ledger")
    assert sorted(int(r["item"]) for r in done.collect()) == ids


def test_trigger_state_survives_micro_batches(spark, root):
    drift = [0.0] * 30 + [0.6] + [0.0] * 30 + [0.4] * 39
    schema = "episode long, t long, drift double, logit double"
    cfg = TR.TriggerConfig(tau_soft=0.3, tau_hard=0.5, timer_soft=10, timer_hard=50)
    for lo, hi in ((0, 25), (25, 70), (70, 100)):
        rows = [(e, t, drift[t], -1.0) for e in (1, 2) for t in range(lo, hi)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{root}/src")
        stream = TR.refresh_stream(FL.file_stream(spark, f"{root}/src", schema), cfg)
        out = FL.run_to_table(stream, f"{root}/out", f"{root}/ckpt")
    fired = sorted(r["t"] for r in out.where("refreshed and episode = 2").collect())
    assert fired == [0, 30, 61, 71, 81, 91]
    hist = {r["t"]: r["history"] for r in out.where("episode = 1").collect()}
    assert hist[0] == 0 and hist[5] == 5 and hist[99] == 16


def test_bimanual_boundary_only_at_segment_start(spark):
    state = [0.0] * 50
    seg = '[{"start":0,"end":5,"level_2":"approach"},{"start":5,"end":12,"level_2":"grasp"}]'
    rows = [(1, t, float(t), "task", state, [0.1] * 24, seg if t == 0 else None) for t in range(12)]
    raw = spark.createDataFrame(
        rows, "episode_index long, frame_index long, timestamp double, task string, state array<double>, "
        "action array<double>, segments string")
    out = AD.BimanualSegmentAdapter().to_frames(raw)
    assert [r["frame_index"] for r in out.where("subtask_label").collect()] == [5]
    row = out.where("frame_index = 3").first()
    assert row["level_1"] == "task" and len(row["action_native"]) == 32 and sum(row["action_mask"]) == 31
    assert row["action_canonical_ee"] == row["action_native"][:7]


def test_keys_of_episodes_are_never_broadcast(spark, root):
    """Their files are small beside their rows, so Spark's estimate must not choose the join."""
    frames = spark.range(3000).select(
        F.lit("s").alias("source"), F.floor(F.col("id") / 1000).alias("chunk"),
        F.floor(F.col("id") / 2).alias("episode_index"), (F.col("id") % 2).alias("frame_index"))
    known = frames.select("source", "chunk", "episode_index").distinct()
    plans, write = [], SK.materialise

    def spy(df, label):
        out = write(df, label)
        plans.append(df._jdf.queryExecution().executedPlan().toString() if label in ("pending", "kept") else "")
        return out

    SK.materialise = spy
    try:
        SK.write_frames(frames.where("episode_index % 3 = 0"), f"{root}/out", f"{root}/ledger", episodes=known)
        SK.write_frames(frames, f"{root}/out", f"{root}/ledger", episodes=known)
    finally:
        SK.materialise = write
    text = "\n".join(plans)
    assert text.count("SortMergeJoin [") >= 4
    assert not [x for x in text.splitlines() if "BroadcastHashJoin" in x and "episode_index" in x]
    assert spark.read.parquet(f"{root}/out").count() == 3000


def test_ids_that_share_a_number_keep_their_frames_apart(spark):
    """ep3894 and ep81374 have the same episode number."""
    pose = "named_struct('joint_position', cast(null as array<double>), 'ee_pose', array(x, 0d, 0d, 0d, 0d, 0d, 0d))"
    none = "named_struct('joint_position', cast(null as array<double>))"
    raw = spark.sql(f"""SELECT id AS episode_id, f AS frame_index, array(x) AS actions, {none} AS master,
        {pose} AS observations, {none} AS puppet, cast(null as binary) AS language_instruction, cast(id as binary) AS language_raw
      FROM (SELECT id, f, CASE id WHEN 'ep3894' THEN f * 0.01D ELSE 5 - f * 0.02D END AS x
        FROM VALUES ('ep3894'), ('ep81374') AS e(id) CROSS JOIN (SELECT explode(sequence(0L, 4L)) AS f))""")
    rows = AD.JointPositionAdapter().to_frames(raw).collect()
    assert len({r.episode_index for r in rows}) == 1
    speed = {"ep3894": 0.25, "ep81374": -0.5}
    assert all(abs(r.action_canonical_ee[0] - speed[r.level_1]) < 1e-5 for r in rows)


def test_groups_stay_whole_behind_a_broadcast_join(spark):
    """Adaptive execution reads the shuffle below a join that it turns into a broadcast one map by map."""
    from epispark.streaming.groups import map_groups

    import pandas as pd

    rows = spark.range(0, 200_000, 1, 8).select((F.col("id") % 500).alias("k"), F.col("id").alias("i"))
    side = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y")).groupBy("k").agg(F.max("y").alias("y"))
    both = rows.join(side, "k", "left")
    size = lambda pdf: pd.DataFrame({"k": pdf["k"].iloc[:1], "n": [len(pdf)]})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # planned as a merge join
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = map_groups(both, ["k"], ["i"], size, "k long, n long").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.k, r.n) for r in got) == [(k, 400) for k in range(500)]


def test_listing_tasks_are_bounded(spark, tmp_path):
    """Forty folders, more than the driver lists itself, are listed by a few tasks."""
    from epispark.sources import readers as RD

    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    spark.range(40).withColumn("episode", F.col("id")).write.partitionBy("episode").parquet(f"{tmp_path}/data")
    spark.conf.unset(name)
    found = RD.episodes_with_fallbacks(spark, str(tmp_path), "*.parquet").collect()
    assert sorted(r.episode_index for r in found) == list(range(40))
    assert int(spark.conf.get(name)) <= RD.LISTING_TASKS


def test_stored_frames_are_not_written_to_scratch_again(spark, root):
    """An increment rewrites a chunk from its files; rows of a crashed job are dropped on the way."""
    frames = spark.range(3000).select(
        F.lit("s").alias("source"), F.floor(F.col("id") / 1000).alias("chunk"),
        F.floor(F.col("id") / 2).alias("episode_index"), (F.col("id") % 2).alias("frame_index"))
    out, ledger, sizes, write = f"{root}/out", f"{root}/ledger", [], SK.materialise

    def spy(df, label):
        made = write(df, label)
        sizes.append(made.count())
        return made

    SK.write_frames(frames.where("episode_index % 3 = 0"), out, ledger)
    stray = frames.where("episode_index in (1, 4)").withColumn("frame_index", F.lit(7).cast("long"))
    stray.write.mode("append").partitionBy("source", "chunk").parquet(out)  # data without marks
    SK.materialise = spy
    try:
        SK.write_frames(frames.where("episode_index % 3 = 1"), out, ledger)
        SK.write_frames(frames, out, ledger)
    finally:
        SK.materialise = write
    assert sizes == [1000, 500, 2, 1000, 500, 0]  # new rows, their episodes, strays
    back = spark.read.parquet(out).select("source", "chunk", "episode_index", "frame_index")
    assert back.count() == 3000 and back.exceptAll(frames.select(back.columns)).count() == 0


def test_finished_items_are_those_whose_latest_status_is_done(spark):
    rows = [("a", "done", 1.0), ("a", "failed", 1.0), ("b", "done", 2.0), ("b", "failed", 1.0), ("c", "done", 1.0),
            ("c", "running", 1.0), ("d", "done", None), ("e", "pending", 3.0), ("e", "done", 2.0), ("f", "requeued", None),
            ("f", "done", None), ("g", None, 1.0), ("g", "done", 1.0), ("h", "odd", 5.0), ("h", "done", 4.0)]
    ledger = spark.createDataFrame(
        [("s", "x", 0, i, st, 1, t) for i, st, t in rows],
        "source string, stage string, chunk long, item string, status string, attempts int, updated_at double")
    want = {r.item for r in SK.latest_status(ledger).where("status = 'done'").collect()}
    assert {r.item for r in SK.finished(ledger).collect()} == want == {"b", "c", "d", "g"}
    assert "SortAggregate" not in SK.finished(ledger)._jdf.queryExecution().executedPlan().toString()


def test_roll_up_does_not_read_its_folders_again(spark, root, monkeypatch):
    from pyspark.sql.readwriter import DataFrameReader

    frames = spark.range(3000).select(
        F.when(F.col("id") >= 20, F.floor(F.sqrt("id"))).alias("episode_index"), F.col("id").alias("frame_index"),
        F.lit("arm").alias("embodiment"))
    read, parquet = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **kw: read.extend(paths) or parquet(self, *paths, **kw))
    for _ in range(2):  # a rerun replaces all three
        SK.roll_up(frames, root, "s", 4, 15, 5, min_frames=40)
    monkeypatch.undo()
    assert read and not [p for p in read if p.endswith("/data")]
    data = spark.read.parquet(f"{root}/data").groupBy("episode_index", "chunk").agg(F.count(F.lit(1)).alias("n")).collect()
    want = {(k, k // 4, 2 * k + 1) for k in range(20, 54)} | {(54, 13, 3000 - 54 * 54)}
    assert {tuple(r) for r in data} == want
    meta = spark.read.parquet(f"{root}/meta/episodes").select("episode_index", "chunk", "length", "embodiment", "file").collect()
    assert {tuple(r) for r in meta} == {(*w, "arm", 0) for w in want}
    info = spark.read.json(f"{root}/meta/info").first()
    assert (info.n_episodes, info.n_frames) == (35, sum(w[2] for w in want))
