"""The bounded-block paths give the same results as the plain ones, also for one hot key."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from epispark import scale
from epispark.operators import windows as W
from epispark.operators.joins import asof_backward, asof_nearest, promote_segments
from epispark.operators.sampling import sample_rate
from epispark.plans import REGISTRY
from epispark.scale import dense_index, exact_quantiles, fill, interval_join, prefix_sum
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def hot(spark):
    """3000 frames, one episode holds 2/3 of them."""
    rng = np.random.default_rng(0)
    rows = [(1, i, float(rng.normal())) for i in range(2000)]
    rows += [(2 + i // 10, i % 10, float(rng.normal())) for i in range(1000)]
    return spark.createDataFrame(rows, "episode long, frame long, x double").cache()


def series(df, *cols):
    out = {}
    for row in df.collect():
        out.setdefault(row["episode"], []).append((row["frame"], *[row[c] for c in cols]))
    return {k: sorted(v) for k, v in out.items()}


def test_dense_index_two_level(spark, hot):
    got = dense_index(hot, ["episode"], ["x", "frame"], [F.floor(F.col("x") * 4)], "rank")
    plain = dense_index(hot, ["episode"], ["x", "frame"], [], "rank")
    assert got.exceptAll(plain).count() == 0 and got.count() == 3000


def test_order_buckets_cuts_large_tables_only(hot):
    assert scale.order_buckets(hot, F.col("frame")) is None
    bucket = scale.order_buckets(hot, F.col("frame"), rows_per_bucket=100)
    sizes = [r["count"] for r in hot.groupBy(bucket.alias("b")).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 1200


def test_order_buckets_leave_short_keys_whole(spark, hot, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_PER_KEY", 1999)
    assert scale.order_buckets(hot, F.col("frame"), 100, keys=["episode"]) is not None
    short = hot.where("episode > 1")
    assert scale.order_buckets(short, F.col("x"), 100) is not None
    assert scale.order_buckets(short, F.col("x"), 100, keys=["episode"]) is None


def test_order_buckets_count_the_cuts_below(hot):
    """Same numbers as comparing every position with every cut, outliers and equal positions included."""
    bucket = scale.order_buckets(hot, F.col("x"), rows_per_bucket=7)
    rows = sorted((r.x, r.b) for r in hot.select("x", bucket.alias("b")).collect())
    ids = [b for _, b in rows]
    assert ids == sorted(ids) and ids[0] == 0 and len(set(ids)) == ids[-1] + 1 > 300


def test_global_rank_of_a_large_table(hot, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_PER_BUCKET", 100)
    got = scale.global_rank(hot, ["episode", "frame"], "i").collect()
    want = sorted((r["episode"], r["frame"]) for r in got)
    assert [(r["episode"], r["frame"]) for r in sorted(got, key=lambda r: r["i"])] == want
    assert sorted(r["i"] for r in got) == list(range(3000))


def test_explode_range(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 25)], "k int, n int")
    got = scale.explode_range(df, F.lit(1), F.col("n"), "t", step=3, size=2)
    assert sorted((r["k"], r["t"]) for r in got.collect()) == [(3, t) for t in range(1, 25, 3)]


def test_prefix_sum_two_level(hot):
    got = prefix_sum(hot, ["episode"], ["frame"], [F.floor(F.col("frame") / 64)], F.col("frame"), "s")
    for rows in series(got, "s").values():
        run = 0
        for frame, s in rows:
            assert s == run
            run += frame


@pytest.mark.parametrize("backward", [False, True])
def test_fill_two_level(hot, backward):
    sparse = F.when(F.col("frame") % 97 == 5, F.col("frame"))
    two = fill(hot, ["episode"], ["frame"], F.floor(F.col("frame") / 16), sparse, "f", backward)
    one = fill(hot, ["episode"], ["frame"], None, sparse, "f", backward)
    assert two.exceptAll(one).count() == 0 and one.exceptAll(two).count() == 0


def test_halo_matches_whole_episode_window(hot):
    small = W.gather_offsets(hot, ["episode"], "frame", {"v": F.col("x")}, [-3, 0, 2], size=8)
    big = W.gather_offsets(hot, ["episode"], "frame", {"v": F.col("x")}, [-3, 0, 2])
    assert small.exceptAll(big).count() == 0 and small.count() == 3000


def test_halo_longer_than_block(hot):
    small = W.moving_average(hot, ["episode"], "frame", "frame", 20, "m", size=4)
    big = W.moving_average(hot, ["episode"], "frame", "frame", 20, "m")
    assert small.exceptAll(big).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 50, 2500, 40000])
def test_exact_quantiles_equal_numpy(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.exponential(3, n), 2)
    df = spark.createDataFrame([(1, float(v)) for v in x], "k int, v double")
    probs = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]
    for small in (2000, 10**6):  # bracketed and whole groups
        got = exact_quantiles(df, ["k"], F.col("v"), probs, small=small, accuracy=1000).first()
        assert got["n"] == n
        assert np.allclose(got["q"], np.quantile(x, probs), atol=1e-12)
    got = exact_quantiles(df, [], F.col("v"), probs, small=2000, accuracy=1000).first()
    assert np.allclose(got["q"], np.quantile(x, probs), atol=1e-12)


def test_exact_quantiles_heavy_ties_and_nan(spark):
    x = [1.0] * 30000 + [2.0] * 10 + [float("nan")] * 5
    df = spark.createDataFrame([(v,) for v in x], "v double")
    got = exact_quantiles(df, [], F.col("v"), [0.5, 0.99999], small=2000, accuracy=1000).first()
    assert got["n"] == 30010 and got["q"][0] == 1.0
    assert np.isclose(got["q"][1], np.quantile(x[:30010], 0.99999))


def test_interval_join_equals_theta_join(spark):
    p = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("at"))
    s = spark.createDataFrame([(1, 5, 9), (1, 0, 300), (1, 64, 64), (1, 60, 130)], "k int, start long, end long")
    got = interval_join(p, s, ["k"], "at", "start", "end", width=16)
    want = p.alias("p").join(s.alias("s"), F.expr("p.k = s.k and at >= start and at < end"))
    assert got.count() == want.count() == 4 + 300 + 70


@pytest.mark.parametrize(
    "name",
    ["win01_finite_difference", "win14_stale_snapshot", "jn04_asof_nearest", "jn05_asof_backward",
     "jn03_promote_segments", "str01_refresh_vector", "fn11_angular_diff", "win20_future_trajectory"],
)
def test_queries_on_the_large_table_plan(spark, sf, monkeypatch, name):
    """With a tiny bucket size every ordered operator takes its two-level plan."""
    monkeypatch.setattr(scale, "ROWS_PER_BUCKET", 100)
    q = REGISTRY[name]
    assert compare(q.build(spark, sf), connect(sf), q.oracle) == ""


def test_asof_ties(spark):
    left = spark.createDataFrame([(1, 10, 0), (1, 20, 1)], "k int, at long, id long")
    right = spark.createDataFrame([(1, 8, 7), (1, 12, 8), (1, 20, 9), (1, 20, 3)], "k int, at long, o long")
    near = {r["id"]: r["m"]["o"] for r in asof_nearest(left, right, ["k"], "at", "o", [], "m").collect()}
    assert near == {0: 7, 1: 3}
    back = {r["id"]: r["m"]["o"] for r in asof_backward(left, right, ["k"], "at", "o", [], "m").collect()}
    assert back == {0: 7, 1: 9}


def test_no_cartesian_or_single_partition_window(spark, sf):
    """Ordered queries never plan a cross join."""
    for name in ("jn03_promote_segments", "jn05_asof_backward", "win04_offsets_first_last", "smp05_draw_steps"):
        plan = REGISTRY[name].build(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_promote_segments_override(spark):
    frames = spark.range(12).select(F.lit(1).alias("e"), F.col("id").alias("f"))
    seg = [(1, "pick", '[{"start":0,"end":5,"level_2":"approach"},{"start":5,"end":12,"level_2":"grasp"},'
                       '{"start":4,"end":6,"level_1":"x"}]')]
    from epispark.functions.text import parse_segments

    heads = spark.createDataFrame(seg, "e int, task string, s string").withColumn("s", parse_segments(F.col("s")))
    out = promote_segments(frames, heads, "e", "f", "task", "s").orderBy("f").collect()
    assert [r["level_2"] for r in out] == ["approach"] * 5 + ["grasp"] * 7
    assert [r["level_1"] for r in out] == ["pick"] * 4 + ["x"] * 2 + ["pick"] * 6
    flags = W.boundary_flag(
        promote_segments(frames, heads, "e", "f", "task", "s"), ["e"], "f", "level_2", "b").where("b")
    assert [r["f"] for r in flags.collect()] == [5]


def test_sample_rate_is_exact(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "a").otherwise("b").alias("d"), "id")
    rates = spark.createDataFrame([("a", 0.25), ("b", 0.333)], "d string, rate double")
    got = {r["d"]: r["count"] for r in sample_rate(df, "d", "id", rates, 1, buckets=64).groupBy("d").count().collect()}
    assert got == {"a": 1000, "b": 333}


def test_outliers_do_not_fill_one_bucket(spark):
    n = 40_000
    at = F.when(F.col("id") % 4000 == 0, F.col("id") * 10**9).otherwise(F.col("id"))
    df = spark.range(n).select(at.alias("frame"))
    bucket = scale.order_buckets(df, F.col("frame"), 1000)
    sizes = [r["count"] for r in df.groupBy(bucket.alias("b")).count().collect()]
    assert len(sizes) == 40 and max(sizes) <= 2 * n / 40


def _small(spark, folder, name, df):
    """The test tables with one of them replaced."""
    import os

    for f in os.listdir("/root/testdata/sf0.001"):
        if f != f"{name}.parquet":
            os.symlink(f"/root/testdata/sf0.001/{f}", f"{folder}/{f}")
    df.toPandas().to_parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_path_template_beyond_its_widths(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", "h") for k in (0, 99, 100_000, 1_234_567)], "page_id long, url string, html string")
    sf = _small(spark, tmp_path, "pages", pages)
    q = REGISTRY["fn07_path_template"]
    assert compare(q.build(spark, sf), connect(sf), q.oracle) == ""


def test_no_fallback_where_an_episode_has_samples(spark, tmp_path):
    lines = spark.range(25).select(F.when(F.col("id") < 22, 1).otherwise(2).cast("long").alias("l_orderkey"))
    sf = _small(spark, tmp_path, "lineitem", lines)
    q = REGISTRY["win07_sample_index_fallback"]
    assert compare(q.build(spark, sf), connect(sf), q.oracle) == ""
    assert [(r.episode, r.t) for r in q.build(spark, sf).collect()] == [(1, 18)]
