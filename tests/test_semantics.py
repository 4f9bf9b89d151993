"""Truth tables, invariants and error cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from epispark.functions import ids as I
from epispark.functions import normalise as N
from epispark.functions import rotation as RT
from epispark.functions import text as X
from epispark.functions import vectors as V
from epispark.operators import evaluation as E
from epispark.operators import joins as J
from epispark.operators import quality as Q
from epispark.operators import sampling as SM
from epispark.operators import stats as S
from epispark.operators import transforms as TF
from epispark.operators import windows as W
from epispark.streaming.trigger import TriggerConfig, refresh_batch, should_refresh


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def lit(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_thresholds(spark):
    log = spark.range(101).select((F.col("id") / 100).alias("d"))
    row = S.calibrate_thresholds(log, [], F.col("d")).first()
    assert row["tau_soft"] == pytest.approx(0.5) and row["tau_hard"] == pytest.approx(0.9)
    row = S.calibrate_thresholds(spark.createDataFrame([(0.42,)], "d double"), [], F.col("d")).first()
    assert row["tau_soft"] == row["tau_hard"] == 0.42
    assert S.calibrate_thresholds(log.where("d > 5"), [], F.col("d")).count() == 0


@pytest.mark.parametrize(
    "t, d, last, cfg, want",
    [
        (60, 0.0, 0, {}, True),
        (59, 0.0, 0, {}, False),
        (5, 0.21, 0, {}, True),
        (5, 0.20, 0, {}, False),
        (15, 0.20, 0, {"tau_hard": 0.5, "tau_soft": 0.1}, False),
        (30, 0.20, 0, {"tau_hard": 0.5, "tau_soft": 0.1}, True),
        (5, 0.0, -1, {}, True),
        (0, 0.0, 0, {}, True),
    ],
)
def test_refresh_truth_table(spark, t, d, last, cfg, want):
    got = should_refresh(F.lit(t), F.lit(d), F.lit(last), F.lit(-1.0), TriggerConfig(**cfg))
    assert one(spark, got)["c0"] is want


def test_stream_of_hundred_fires_six_times(spark):
    drift = [0.0] * 30 + [0.6] + [0.0] * 30 + [0.4] * 39
    rows = spark.createDataFrame([(1, t, d) for t, d in enumerate(drift)], "episode long, t long, d double")
    cfg = TriggerConfig(tau_soft=0.3, tau_hard=0.5, timer_soft=10, timer_hard=50)
    for size in (50, 4096):
        out = refresh_batch(rows, "episode", "t", F.lit(-1.0), drift=F.col("d"), config=cfg, size=size)
        fired = sorted(r["t"] for r in out.where("refreshed").collect())
        assert fired == [0, 30, 61, 71, 81, 91]
        assert out.agg(F.max("refresh_count")).first()[0] == 6


def test_blocked_vector_trigger_equals_plain(spark):
    rng = np.random.default_rng(3)
    rows = [(1, t, [float(v) for v in rng.normal(size=3)]) for t in range(400)]
    df = spark.createDataFrame(rows, "episode long, t long, e array<double>")
    cfg = TriggerConfig(tau_soft=1.2, tau_hard=1.7, timer_soft=5, timer_hard=20)
    a = refresh_batch(df, "episode", "t", F.lit(-1.0), vector=F.col("e"), config=cfg, size=20)
    b = refresh_batch(df, "episode", "t", F.lit(-1.0), vector=F.col("e"), config=cfg)
    drop = lambda d: d.select("t", "refreshed", "refresh_count", F.round("drift", 9).alias("d"))
    assert drop(a).exceptAll(drop(b)).count() == 0 and a.count() == 400


def test_cosine_distance(spark):
    row = one(spark, V.cosine_distance(lit(1, 2), lit(1, 2)), V.cosine_distance(lit(1, 0), lit(0, 1)))
    assert row["c0"] == pytest.approx(0) and row["c1"] == pytest.approx(1)


def test_floored_modulo_and_clip_nan(spark):
    row = one(spark, V.floored_mod(F.lit(-4.0), 2 * math.pi), V.clip(F.lit(float("nan")), -2, 2),
              V.wrap_angle(F.lit(math.pi)))
    assert row["c0"] == pytest.approx(2.283185307) and math.isnan(row["c1"])
    assert row["c2"] == pytest.approx(-math.pi)


def test_validity_bounds(spark):
    good, nan = lit(2, 0, 0, math.pi, 0, 0, 1), lit(0, 0, float("nan"), 0, 0, 0, 0)
    row = one(spark, V.canonical_ok(good), V.canonical_ok(nan), V.canonical_ok(lit(2.1, 0, 0, 0, 0, 0, 0)),
              V.canonical_ok(lit(0, 0)), V.canonical_ok(V.clip_canonical(lit(9, -9, 9, 9, -9, 9, 9))))
    assert [row[i] for i in range(5)] == [True, False, False, False, True]


def test_first_seven_needs_seven_dims(spark):
    with pytest.raises(PySparkException):
        one(spark, V.first_seven(lit(1, 2, 3), [1.0] * 7))


@pytest.mark.parametrize("mode", N.INVERTIBLE)
def test_normalise_round_trip(spark, mode):
    s = {k: F.lit(v) for k, v in {"mean": 2.0, "std": 3.0, "min": -4.0, "max": 8.0, "q01": -3.0, "q99": 7.0}.items()}
    x = F.lit(1.0 if mode == "binary" else 1.5)
    row = one(spark, N.inverse(N.forward(x, s, mode), s, mode), x)
    assert row["c0"] == pytest.approx(row["c1"])


def test_normalise_degenerate(spark):
    s = {k: F.lit(5.0) for k in ("mean", "min", "max", "q01", "q99")} | {"std": F.lit(0.0)}
    got = [one(spark, N.forward(F.lit(5.0), s, m))["c0"] for m in ("q99", "mean_std", "min_max")]
    assert got == [1.0, 5.0, 0.0]
    with pytest.raises(ValueError):
        N.inverse(F.lit(1.0), s, "scale")


def test_merge_of_a_split_equals_the_union(spark):
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", 0, float(v)) for i, v in enumerate(rng.normal(size=900))]
    df = spark.createDataFrame(rows, "ds string, dim int, value double")
    parts = S.column_statistics(df, ["ds", "dim"])
    weights = parts.select("ds", F.col("n").alias("weight"))
    merged = S.merge_statistics(parts.drop("n"), weights, "ds", ["dim"]).first()
    whole = S.column_statistics(df, ["dim"]).first()
    for k in ("mean", "std", "min", "max"):
        assert merged[k] == pytest.approx(whole[k])


def test_delta_integration_identity_over_blocks(spark):
    rng = np.random.default_rng(7)
    pose = ["x", "y", "z", "r", "p", "w"]
    rows = [(1 + t // 150, t % 150, *[float(v) for v in rng.uniform(-1.2, 1.2, 6)]) for t in range(300)]
    df = spark.createDataFrame(rows, "e long, f long, " + ", ".join(f"{c} double" for c in pose))
    d = W.pose_deltas(df, ["e"], "f", pose, size=16)
    back = W.integrate_deltas(d, df.where("f = 0"), "e", "f", [f"d_{c}" for c in pose], pose, size=16)
    want = {(r["e"], r["f"]): [r[c] for c in pose] for r in df.collect()}
    got = {(r["e"], r["f"]): [r[c] for c in pose] for r in back.collect()}
    assert want.keys() == got.keys()
    assert max(np.abs(np.subtract(want[k], got[k])).max() for k in want) < 1e-9


@pytest.mark.parametrize("other", ["axis_angle", "quaternion", "rotation_6d", "matrix"])
def test_rotation_round_trip(spark, other):
    rng = np.random.default_rng(11)
    rows = [([float(v) for v in rng.uniform(-1.3, 1.3, 3)],) for _ in range(50)]
    df = spark.createDataFrame(rows, "e array<double>")
    there = df.withColumn("o", RT.convert_rotation(F.col("e"), "euler_angles_rpy", other))
    back = there.withColumn("b", RT.convert_rotation(F.col("o"), other, "euler_angles_rpy"))
    for r in back.collect():
        assert np.allclose(r["e"], r["b"], atol=1e-8)
    with pytest.raises(ValueError):
        RT.convert_rotation(F.col("e"), "matrix", "matrix")


def test_principal_components_match_numpy(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(200, 5)) * [5, 3, 2, 0.5, 0.1]
    df = spark.createDataFrame([(0, i, [float(v) for v in r]) for i, r in enumerate(x)], "g int, i int, v array<double>")
    got = E.principal_components(df.repartition(4), "g", "i", "v", 5).orderBy("i").collect()
    c = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    for k in range(3):
        comp = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        s = c @ comp
        s = (s - s.min()) / (s.max() - s.min())
        assert np.allclose([r[f"pc{k}"] for r in got], s, atol=1e-8)


def test_soft_spearman_agreement(spark):
    up, down = lit(1, 2, 3, 4), lit(4, 3, 2, 1)
    row = one(spark, E.soft_spearman(up, up), E.soft_spearman(up, down))
    assert row["c0"] > 0.99 and row["c1"] < -0.99


def test_soft_spearman_of_rows_of_any_length(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *([float(v) for v in rng.normal(size=n)] for _ in range(2))) for i, n in enumerate([4, 9, 4, 1500, 9, 1])]
    df = spark.createDataFrame([*rows, (9, None, [1.0])], "i int, a array<double>, b array<double>")
    got = {r.i: r.c for r in df.coalesce(1).select("i", E.soft_spearman(F.col("a"), F.col("b")).alias("c")).collect()}
    for i, *pair in rows:
        x, y = ((1 / (1 + np.exp(np.subtract.outer(v, v)))).sum(axis=0) for v in map(np.array, pair))
        x, y = x - x.mean(), y - y.mean()
        assert abs(got[i] - (x * y).sum() / np.sqrt(((x**2).sum() + 1e-8) * ((y**2).sum() + 1e-8))) < 1e-9
    assert got[9] is None


def test_info_nce_rejects_larger_batches(spark):
    df = spark.createDataFrame([(0, i, [1.0, float(i)]) for i in range(5)], "b long, i long, v array<double>")
    with pytest.raises(Exception, match="more than 3"):
        E.info_nce(df, "b", "i", "v", "v", batch_rows=3).collect()


def test_weights(spark):
    mix = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "name string, weight double")
    assert {r["name"]: r["weight"] for r in SM.normalise_weights(mix).collect()} == {"a": 0.25, "b": 0.75}
    for bad in ([("a", -1.0), ("b", 2.0)], [("a", 0.0)]):
        with pytest.raises(PySparkException):
            SM.normalise_weights(spark.createDataFrame(bad, "name string, weight double")).collect()


def test_weighted_draws_follow_the_mixture(spark):
    mix = spark.createDataFrame([("a", 1.0, 10), ("b", 3.0, 1000)], "name string, weight double, items long")
    out = SM.draw_items(SM.draws(spark, 4000), mix, "draw", 1)
    counts = {r["name"]: r["count"] for r in out.groupBy("name").count().collect()}
    assert abs(counts["b"] / 4000 - 0.75) < 0.03
    assert out.where("name = 'a' and item >= 10").count() == 0


def test_task_batches_cover_every_task(spark):
    out = SM.task_batches(spark, 50, 8, {"p": 0.7, "q": 0.2, "r": 0.1}, seed=3, rank=1, replicas=2)
    per = out.groupBy("batch").agg(F.count_distinct("task").alias("k"), F.count("*").alias("n"), F.count_distinct("position").alias("p"))
    assert per.where("k < 3 or n <> 8 or p <> 8").count() == 0
    index = out.groupBy("task").agg(F.count("*").alias("n"), F.min("index").alias("lo"), F.max("index").alias("hi"))
    assert index.where("lo <> 1 or hi <> 1 + 2 * (n - 1)").count() == 0
    with pytest.raises(ValueError):
        SM.task_batches(spark, 1, 2, {"p": 1, "q": 1, "r": 1}, seed=0)


def test_ready_work_needs_all_earlier_stages(spark):
    rows = [(1, 0, "done"), (1, 1, "pending"), (1, 2, "pending"), (2, 1, "pending"), (3, 0, "requeued")]
    df = spark.createDataFrame(rows, "chunk long, stage long, status string")
    got = {(r["chunk"], r["stage"]) for r in J.ready_work(df, ["chunk"], "stage", "status").collect()}
    assert got == {(1, 1), (3, 0)}


def test_unknown_embodiment_is_an_error(spark):
    df = spark.createDataFrame([("x",)], "embodiment string")
    rules = spark.createDataFrame([("y", 7)], "embodiment string, native_dim int")
    with pytest.raises(PySparkException):
        J.attach_rule(df, rules).select("embodiment").collect()


def test_unique_position_is_checked(spark):
    df = spark.createDataFrame([(1, 0), (1, 1)], "id int, pos int")
    with pytest.raises(PySparkException):
        J.unique_position(df, ["id"], "pos").collect()


def test_short_episodes_all_dropped_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "e int")
    with pytest.raises(PySparkException):
        Q.require_rows(Q.long_enough(df, "e", 32), "episodes").collect()


def test_shards_partition_the_episodes(spark):
    df = spark.range(10).select(F.col("id").alias("i"), (F.col("id") % 4).alias("s"))
    row = Q.shard_audit(df, "i", "s").first()
    assert (row["n_overlapping"], row["n_unassigned"], row["n_items"]) == (0, 0, 10)


def test_text_helpers(spark):
    turns = F.array(
        F.struct(F.lit("gpt").alias("from"), F.lit("skip me").alias("value")),
        F.struct(F.lit("human").alias("from"), F.lit("  two words ").alias("value")))
    row = one(spark, X.conversation_words(turns), X.normalise_turns(turns),
              X.parse_json_span(F.lit('x {"a": 1}\n y'), "a int"), X.json_span(F.lit("none")),
              X.decode_text(F.unhex(F.lit("41FF42"))))
    assert row["c0"] == 4 and [t["role"] for t in row["c1"]] == ["user"]
    assert row["c2"]["a"] == 1 and row["c3"] is None and row["c4"] == "AB"


def test_ids(spark):
    import hashlib

    row = one(spark, I.episode_hash(F.lit("a::b")), I.id_from_hash(F.lit("a::b")), I.episode_key(F.lit(7)),
              I.parse_episode_key(F.lit("ep_00000012")), I.parse_episode_key(F.lit("ep_x")),
              I.readable_id(F.lit("root/run3/data/trajectory.h5")))
    h = hashlib.sha256(b"a::b").hexdigest()[:12]
    assert row["c0"] == h and row["c1"] == int(h, 16) % (2**31 - 1)
    assert (row["c2"], row["c3"], row["c4"], row["c5"]) == ("ep_00000007", 12, None, "run3")
    with pytest.raises(PySparkException):
        one(spark, I.episode_hash(F.lit("")))


def test_transform_rules():
    with pytest.raises(ValueError):
        TF.StateAction("r", "quaternion", "rotation_6d", mode="q99", bounds=(-1, 1))
    with pytest.raises(ValueError):
        TF.StateAction("r", "quaternion", "rotation_6d", absolute=False)
    with pytest.raises(ValueError):
        TF.StateAction("r", mode="min_max", continuous=False)


def test_random_transforms_off_in_eval(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "k int, v array<double>")
    chain = TF.Compose([TF.Perturb("v", 0.5, 1, "k"), TF.Dropout("v", 1.0, 1, "k")])
    assert chain.train().apply(df).first()["v"] == [0.0, 0.0, 0.0]
    assert chain.eval().apply(df).first()["v"] == [1.0, 2.0, 3.0]


def test_observation_offsets_are_checked(spark):
    df = spark.createDataFrame([(1, 0, 1.0)], "e long, f long, v double")
    for bad in ([-2, -1], [-4, -1, 0], [0, 1]):
        with pytest.raises(ValueError):
            W.history_stack(df, ["e"], "f", {"h": F.col("v")}, bad)


def test_ensemble_state_is_asked_only_for_continued_episodes():
    """Steps of a micro-batch are computed together; a batch that begins an episode needs no state."""
    import pandas as pd

    from epispark.streaming.trigger import EnsembleProcessor

    class State:
        rows, asked = [], 0

        def get(self):
            self.asked += 1
            return iter(self.rows)

        def put(self, rows):
            self.rows = rows

    rnd = np.random.default_rng(2)
    t = [*range(7), *range(5)]  # the episode starts twice
    chunks = [[rnd.normal(size=2) for _ in range(3 + i % 2)] for i in range(12)]
    run, got = EnsembleProcessor(3, 1.5), []
    run.chunks = State()
    for lo, hi in ((0, 3), (3, 4), (4, 10), (10, 12)):
        order = range(hi - 1, lo - 1, -1) if hi <= 7 else range(lo, hi)
        pdf = pd.DataFrame({"t": [t[i] for i in order], "chunk": [chunks[i] for i in order]})
        if hi == 10:  # frames 4 to 6 of one run, then a new one: one start a batch, so deliver them apart
            for part in (pdf[:3], pdf[3:]):
                got += [x for out in run.handleInputRows((1,), iter([part]), None) for x in out.itertuples(index=False)]
            continue
        got += [x for out in run.handleInputRows((1,), iter([pdf]), None) for x in out.itertuples(index=False)]
    for i, x in enumerate(got):
        preds = np.array([chunks[i - a][a] for a in range(min(t[i] + 1, 3))])
        cos = preds @ preds[0] / (np.linalg.norm(preds, axis=1) * np.linalg.norm(preds[0]) + 1e-7)
        w = np.exp(1.5 * cos)
        assert (x.episode, x.t, x.n_preds) == (1, t[i], len(preds)) and np.allclose(x.action, w @ preds / w.sum())
    assert len(got) == 12 and run.chunks.asked == 3 and len(run.chunks.rows) == 3
    short = pd.DataFrame({"t": [0, 1], "chunk": [chunks[0][:1], chunks[1]]})
    with pytest.raises(IndexError):
        list(run.handleInputRows((1,), iter([short]), None))
