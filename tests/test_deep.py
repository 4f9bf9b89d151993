"""Stores, smooth ranks, tiled scores, alias tables and record files against plain computation."""

from __future__ import annotations

import collections
import json
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark.operators.alias import alias_draws, alias_table
from epispark.operators.contrastive import tiled_info_nce
from epispark.operators.evaluation import info_nce, soft_spearman
from epispark.operators.smooth_ranks import group_spearman, smooth_ranks
from epispark.operators.subspace import wide_components
from epispark.session import materialise, scratch_path
from epispark.sources import record_format as RF
from epispark.sources.feature_store import lookup, write_store


def ranks(x, tau):
    with np.errstate(over="ignore"):
        return (1 / (1 + np.exp((x[None, :] - x[:, None]) / tau))).sum(axis=1) + 0.5


@pytest.mark.parametrize("tau, spread", [(1.0, 3.0), (0.01, 50.0), (30.0, 1.0), (1.0, 1e6)])
def test_smooth_ranks(spark, tau, spread):
    x = np.random.default_rng(1).normal(0, spread, 3000)
    x[:500] = x[0]
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)] + [("g", -1, None), (None, -2, 1.0)], "k string, i long, x double")
    got = {r.i: r.rank for r in smooth_ranks(df.repartition(4), "k", "x", tau).collect()}
    want = ranks(x, tau)
    assert max(abs(got[i] - w) / w for i, w in enumerate(want)) < 1e-9
    assert got[-1] is None and math.isclose(got[-2], 1.0)


def test_group_spearman_equals_the_array_form(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(a), float(a * g + b)) for g in range(3) for a, b in rng.normal(0, 1, (200, 2))]
    df = spark.createDataFrame(rows, "g long, a double, b double")
    arrays = df.groupBy("g").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    want = {r.g: r.rho for r in arrays.select("g", soft_spearman(F.col("a"), F.col("b"), 0.3).alias("rho")).collect()}
    odd = df.unionByName(spark.createDataFrame([(0, None, 1.0), (1, float("nan"), 2.0), (2, 1.0, float("inf"))], df.schema))
    got = {r.g: r for r in group_spearman(odd, "g", "a", "b", 0.3).collect()}
    assert all(abs(got[g].rho - want[g]) < 1e-9 and got[g].n == 200 for g in want)


def test_large_group(spark):
    """A group of 10^5 rows, half of them equal."""
    df = spark.range(100_000).select(F.lit(0).alias("g"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") / 1000.0).alias("x"))
    got = smooth_ranks(df, "g", "x", 1e-4).where("x = 0").agg(F.min("rank"), F.max("rank")).first()
    assert abs(got[0] - 25_000.5) < 1e-4 and got[0] == got[1]


def test_tiles_equal_one_task(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 2, k, rng.normal(0, 1, 5).tolist(), rng.normal(0, 1, 5).tolist()) for k in range(80)]
    df = spark.createDataFrame(rows, "b int, i long, s array<double>, t array<double>")
    want = {r.b: r.loss for r in info_nce(df, "b", "i", "s", "t", 100).collect()}
    for tile in (7, 512):
        got = {r.b: r for r in tiled_info_nce(df, "b", "i", "s", "t", tile=tile).collect()}
        assert all(abs(got[b].loss - want[b]) < 1e-9 and got[b].n == 40 for b in want)
    one = tiled_info_nce(df.limit(1), "b", "i", "s", "t").first()
    assert one.n == 1 and abs(one.loss) < 1e-12
    assert tiled_info_nce(df.limit(0), "b", "i", "s", "t").count() == 0


@pytest.mark.parametrize("weights", [[1.0], [0.0, 2.0, 0.0], [5.0, 1, 1, 1, 1, 1], [1.0] * 7, [1, 2, 3, 4, 1000, 0.5, 7, 7]])
def test_alias_table_has_the_weights(spark, weights):
    table = alias_table(spark.createDataFrame([(f"s{k}", float(w)) for k, w in enumerate(weights)], "name string, weight double"))
    mass, rows = collections.Counter(), table.collect()
    assert sorted(r.slot for r in rows) == list(range(len(weights)))
    for r in rows:
        assert 0 <= r.keep <= r.room
        mass[r.name] += r.keep / r.room / len(rows)
        mass[r.alias] += (r.room - r.keep) / r.room / len(rows)
    for k, w in enumerate(weights):
        assert abs(mass[f"s{k}"] - w / sum(weights)) < 1e-9


def test_alias_draws_of_many_sources(spark):
    mix = spark.range(100_000).select(F.col("id").alias("name"), (F.col("id") % 97 + F.when(F.col("id") == 5, 2e6).otherwise(0)).alias("weight"))
    table = materialise(alias_table(mix), "alias")
    draws = spark.range(50_000).withColumnRenamed("id", "draw")
    one, two = (alias_draws(draws, table, "draw", 3) for _ in range(2))
    assert one.exceptAll(two).isEmpty() and one.count() == 50_000
    share = one.where("name = 5").count() / 50_000
    assert abs(share - 2e6 / (2e6 + 48 * 100_000)) < 0.01
    assert alias_table(mix.limit(0)).count() == alias_table(mix.withColumn("weight", F.lit(0.0))).count() == 0


def test_positional_store(spark):
    feats = spark.range(5000).select((F.col("id") % 3).alias("episode_index"), F.floor(F.col("id") / 3).alias("feat_idx"), (F.col("id") * 2).alias("v"))
    store = write_store(feats, f"s_{uuid.uuid4().hex}", buckets=4, block=100)
    asked = spark.createDataFrame(
        [(1, 0, [5, 1666, 0, 5, 9999, -1]), (2, 2, [3]), (3, 77, [1, 0]), (4, 1, []), (5, 1, None)],
        "request long, episode_index long, positions array<long>",
    )
    out = lookup(spark, store, asked, ["v"], block=100)
    got = {r.request: ([(x.at, x.position, x.v) for x in r.rows], r.missing) for r in out.collect()}
    assert got[1] == ([(0, 5, 30), (1, 1666, 9996), (2, 0, 0), (3, 5, 30)], [9999, -1])
    assert got[2] == ([(0, 3, 22)], []) and got[3] == ([], [1, 0]) and got[4] == got[5] == ([], [])
    plan = lookup(spark, store, asked, ["v"], block=100)._jdf.queryExecution().executedPlan().toString()
    stored = plan[plan.index("+- Sort [__e") :]  # the join's stored side, down to its scan
    assert "Bucketed: true" in stored and "Exchange" not in stored
    assert plan.count("hashpartitioning(episode_index") == 1


def test_record_files(spark):
    root = scratch_path(spark, "records")
    fs, at = RF._open(root)
    fs.create_dir(at)
    for k in range(40):
        body = json.dumps({"episode_id": k, "steps": [{"action": [k, j]} for j in range(3)]}) if k % 10 else "{"
        with fs.open_output_stream(f"{at}/episode_{k:03d}.json") as f:
            f.write(body.encode())
    RF.register(spark)
    rows = spark.read.format(RF.FORMAT).load(root)
    assert rows.where("error IS NULL").count() == 36 * 3 and rows.where("error IS NOT NULL").count() == 4
    some = RF.read_episodes(spark, root, [3, 7]).where("frame_index = 1").collect()
    assert sorted(tuple(r.action) for r in some) == [(3.0, 1.0), (7.0, 1.0)]
    assert rows.where("episode_id = 3").count() == 3 and rows.where("episode_id = 4").count() == 3
    reader = RF.PushedRecordReader(root)
    list(reader.pushFilters([RF.In(("episode_id",), (3, 7)), RF.EqualTo(("frame_index",), 1)]))
    assert [p.rsplit("_", 1)[-1] for x in reader.partitions() for p in x.paths] == ["003.json", "007.json"]
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")

    def run():
        stream = spark.readStream.format(RF.FORMAT).load(root)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    assert run().exceptAll(rows).isEmpty() and rows.exceptAll(run()).isEmpty()
    with fs.open_output_stream(f"{at}/episode_900.json") as f:
        f.write(b'{"episode_id": 900, "steps": [{"action": [1]}]}')
    assert run().count() == 36 * 3 + 4 + 1
    assert run().count() == 36 * 3 + 4 + 1


def test_segment_function(spark):
    from epispark.operators.table_functions import promote

    text = json.dumps([{"start": -1, "end": 2, "level_1": "a", "level_2": "b"}, {"start": 1, "end": 3, "level_2": "c"}, {"start": 0}, 5])
    rows = [(1, k, "task" if k == 0 else None, text if k == 0 else None) for k in range(4)]
    rows += [(2, 0, "other", "{no json"), (3, 0, None, None), (4, 0, "t", "7")]
    df = spark.createDataFrame(rows, "episode long, frame long, task string, segments string").repartition(3)
    got = {(r.episode, r.frame): (r.level_1, r.level_2, r.level_3) for r in promote(spark, df).collect()}
    assert got == {(1, 0): ("a", "b", ""), (1, 1): ("a", "c", ""), (1, 2): ("task", "c", ""), (1, 3): ("task", "", ""),
                   (2, 0): ("other", "", ""), (3, 0): ("", "", ""), (4, 0): ("t", "", "")}
    assert promote(spark, df.limit(0)).count() == 0


def test_silent_episodes_keep_their_state_over_runs(spark):
    from epispark.streaming.flows import file_stream, run_to_table
    from epispark.streaming.sessions import close_silent

    src, out, state = (scratch_path(spark, x) for x in ("src", "out", "state"))
    schema = "episode long, at timestamp"

    def arrive(*rows):
        df = spark.createDataFrame([(e, s) for e, s in rows], "episode long, s long")
        df.select("episode", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(src)
        stream = close_silent(file_stream(spark, src, spark.createDataFrame([], schema).schema), "episode", "at", 60_000, "10 seconds")
        return sorted(tuple(r) for r in run_to_table(stream, out, state).collect())

    assert arrive((1, 1000), (1, 1030), (2, 1000), (1, 1091)) == [(1, 1_000_000, 1_030_000, 2), (2, 1_000_000, 1_000_000, 1)]
    third = arrive((3, 1200))
    assert third[-1] != (3, 1_200_000, 1_200_000, 1) and (1, 1_091_000, 1_091_000, 1) in third and len(third) == 3


def leading(x, k=3):
    """Scaled scores of the leading eigenvectors of all columns."""
    c = x - x.mean(axis=0)
    _, vectors = np.linalg.eigh(c.T @ c / len(x))
    comps = vectors[:, ::-1][:, :k]
    s = c @ (comps * np.sign(np.take_along_axis(comps, np.abs(comps).argmax(axis=0)[None, :], axis=0)))
    return (s - s.min(axis=0)) / (s.max(axis=0) - s.min(axis=0))


@pytest.mark.parametrize("width, spread", [(64, "slow"), (64, "none"), (300, "slow"), (5, "slow")])
def test_wide_components(spark, width, spread):
    rng = np.random.default_rng(width)
    scale = 0.97 ** np.arange(width) if spread == "slow" else np.ones(width)
    x = {g: rng.normal(size=(n, width)) * scale + 3 for g, n in (("a", 2500), ("b", 700))}
    rows = [(g, i, [float(v) for v in row]) for g, m in x.items() for i, row in enumerate(m)]
    df = spark.createDataFrame(rows, "g string, i long, v array<double>").repartition(5)
    got = {(r.g, r.i): r for r in wide_components(df, "g", "i", "v").collect()}
    for g, m in x.items():
        want = leading(m)
        have = np.array([[got[g, i][f"pc{j}"] for j in range(3)] for i in range(len(m))])
        assert np.abs(have - want).max() < 1e-6


def test_wide_components_on_odd_rows(spark):
    rows = [(None, 1, [0.0, 0.0]), (None, 2, [1.0, 1.0]), (None, 2, [1.0, 1.0]), (1, 3, None), (1, 4, [1.0, None]),
            (1, 5, [float("nan"), 1.0]), (2, 6, [4.0]), (2, 7, [6.0]), (3, 8, [2.0, 2.0, 2.0]), (3, None, [2.0, 2.0, 2.0]), (4, 9, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "key long, row long, v array<double>, x string")
    got = collections.Counter(tuple(r) for r in wide_components(df, "key", "row", "v", k=2).collect())
    assert set((a, b) for a, b, *_ in got) == {(None, 1), (None, 2), (2, 6), (2, 7), (3, 8), (3, None)}
    assert {(a, b): round(c, 6) for a, b, c, _ in got if a != 3} == {(None, 1): 0, (None, 2): 1, (2, 6): 0, (2, 7): 1}
    assert sum(got.values()) == 7 and all(d is None for a, _, _, d in got if a == 2)
    assert wide_components(df.limit(0), "key", "row", "v").count() == 0
    mixed = spark.createDataFrame([(1, 1, [1.0]), (1, 2, [1.0, 2.0])], "key long, row long, v array<double>")
    with pytest.raises(Exception, match="differ in width"):
        wide_components(mixed.coalesce(1), "key", "row", "v").count()


def test_filters_know_what_they_hold():
    import hashlib

    from epispark.streaming.seen import build_filter, may_hold

    names = [hashlib.md5(str(i).encode()).hexdigest() for i in range(30_000)]
    bits = build_filter(names[:10_000])
    assert may_hold(bits, names[:10_000]).all()
    assert may_hold(bits, names[10_000:]).mean() < 0.005


def test_repeats_after_any_time(spark):
    from epispark.streaming.flows import file_stream
    from epispark.streaming.seen import drop_repeats_ever

    src, out, seen, state = (scratch_path(spark, x) for x in ("src", "out", "seen", "state"))
    year = 31_536_000

    def arrive(rows, state=state):
        if rows:
            df = spark.createDataFrame(rows, "key string, s long")
            df.select("key", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(src)
        stream = file_stream(spark, src, spark.createDataFrame([], "key string, at timestamp").schema)
        drop_repeats_ever(stream, ["key"], "at", out, seen, state, digits=1)
        back = spark.read.schema("key string, at timestamp").parquet(out)
        return sorted(((r.key, r.s) for r in back.select("key", F.unix_seconds("at").alias("s")).collect()), key=lambda x: x[1])

    first = [("a", 5), ("b", 6), (None, 7)]
    assert arrive([("a", 5), ("b", 6), ("a", 9), (None, 7), (None, 8)]) == first
    assert arrive([("a", 5 + year), ("c", 5 + year), (None, 1 + year)]) == [*first, ("c", 5 + year)]  # a year later
    assert arrive([("b", 6 + 9 * year), ("a", 1)]) == [*first, ("c", 5 + year)]
    assert arrive([], scratch_path(spark, "state")) == [*first, ("c", 5 + year)]


@pytest.mark.parametrize("stop", ["filters", "out"])
def test_a_stopped_batch_is_replayed_whole(spark, monkeypatch, stop):
    from epispark.streaming import seen as SN
    from epispark.streaming.flows import file_stream

    root = scratch_path(spark, "replay")
    rows = spark.createDataFrame([(k % 5, k) for k in range(40)], "key long, s long")
    rows.select("key", F.timestamp_seconds("s").alias("at")).coalesce(1).write.parquet(f"{root}/src")

    def run():
        stream = file_stream(spark, f"{root}/src", spark.read.parquet(f"{root}/src").schema)
        SN.drop_repeats_ever(stream, ["key"], "at", f"{root}/out", f"{root}/seen", f"{root}/state", digits=1)

    write = SN.replace_parts

    def stopping(df, path, *parts):
        if path.endswith(stop):
            raise RuntimeError("stopped here")
        write(df, path, *parts)

    monkeypatch.setattr(SN, "replace_parts", stopping)
    with pytest.raises(Exception, match="stopped here"):
        run()
    monkeypatch.setattr(SN, "replace_parts", write)
    run()
    got = spark.read.schema("key long, at timestamp").parquet(f"{root}/out")
    assert sorted((r.key, r.s) for r in got.select("key", F.unix_seconds("at").alias("s")).collect()) == [(k, k) for k in range(5)]


def test_slots_are_sent_as_rows_and_few_times(spark, monkeypatch):
    """No row handed to a task holds a whole tile, and a row is sent once per slot, not once per tile."""
    from epispark.operators import contrastive as CT

    monkeypatch.setattr(CT, "SLOT", 100)
    monkeypatch.setattr(CT, "SLOTS", 2)
    rng = np.random.default_rng(5)
    rows = [(None, k, *[rng.normal(0, 1, 4).tolist() for _ in "st"]) for k in range(300)]
    df = spark.createDataFrame(rows, "b int, i long, s array<float>, t array<float>")
    sent = CT.paired_slots(df, "b", "i", "s", "t", tile=8)
    assert dict(sent.dtypes)["v"] == "array<float>" and sent.count() == 2 * 300 * 3
    got = CT.tiled_info_nce(df, "b", "i", "s", "t", tile=8).collect()
    want = info_nce(df.withColumn("b", F.lit(0)), "b", "i", "s", "t", 300).first()
    assert len(got) == 1 and got[0].b is None and got[0].n == 300 and abs(got[0].loss - want.loss) < 1e-6


def test_scores_leave_a_task_few_blocks_at_a_time():
    import pyarrow as pa

    from epispark.operators import subspace as SS

    n, m = 5 * SS.HELD, 3
    lists = lambda x: pa.array(x, pa.list_(pa.float64()))
    x = np.random.default_rng(3).normal(size=(n, m, 2))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["k"] * n), pa.array([0] * n), pa.array([list(range(i * m, i * m + m)) for i in range(n)]), pa.array([m] * n),
         lists([b.ravel().tolist() for b in x]), lists([[0.5, 1.0]] * n), lists([[0.0, 1.0, 1.0, 0.0]] * n)],
        names=["key", "group", "rows", "m", "x", "mean", "p"])
    out = list(SS._scores(3)([batch, batch.slice(0, 0)]))
    assert max(b.num_rows for b in out) == SS.HELD * m
    got = pa.Table.from_batches(out).to_pydict()
    assert got["row"] == list(range(n * m)) and got["pc2"] == [None] * (n * m)
    assert np.allclose(np.c_[got["pc0"], got["pc1"]], x.reshape(-1, 2)[:, ::-1] - [1.0, 0.5])


def test_record_tasks_are_bounded(monkeypatch):
    """Many files make longer runs, not ever more tasks; few files stay spread."""
    for n in (0, 40, 100_000):
        files = [f"r/episode_{k:012d}.json" for k in range(n)]
        monkeypatch.setattr(RF, "list_records", lambda root, files=files: files)
        parts = RF.RecordReader("r").partitions()
        assert [f for p in parts for f in p.paths] == files
        assert len(parts) <= RF.MAX_PARTITIONS and max(len(p.paths) for p in parts) <= max(16, -(-n // 128))
        stream = RF.RecordStream("r").partitions({"after": ""}, {"after": "s"})
        assert [f for p in stream for f in p.paths] == files and len(stream) <= RF.MAX_PARTITIONS
