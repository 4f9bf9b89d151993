"""Statistics, normalisation and evaluation queries (AGG-*, FN-13..18, JN-11/15/16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.functions import normalise as N
from epispark.functions import vectors as V
from epispark.functions.ids import fingerprint
from epispark.functions.rotation import box_iou
from epispark.operators import evaluation as E
from epispark.operators import stats as S
from epispark.operators import windows as W
from epispark.plans.q_windows import PI, POSE6, _delta_sql, u_sql, wrap_sql
from epispark.plans.registry import R, query, r
from epispark.session import materialise
from epispark.plans.views import (
    EV, LF, LONG, PF, line_frames, line_vector, long_values, pose_frames, signal_frames, table,
)

DIMS = ["x0", "x1", "x2", "x3"]


def six_sql(value: str = "value", n: int = 4) -> str:
    v = value
    return (
        f"{R(f'avg({v})', n)} AS mean, {R(f'stddev_pop({v})', n)} AS std, "
        f"{R(f'min({v})', n)} AS min, {R(f'max({v})', n)} AS max, "
        f"{R(f'quantile_cont({v}, 0.01)', n)} AS q01, {R(f'quantile_cont({v}, 0.99)', n)} AS q99"
    )


def six(n: int = 4):
    return [r(F.col(c), n).alias(c) for c in S.STATS]


def long_lines(spark, sf):
    """Value columns in long form, read straight from the scan (no frame index needed)."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_quantity").cast("double").alias("x0"),
        F.col("l_extendedprice").cast("double").alias("x1"),
        F.col("l_discount").cast("double").alias("x2"),
        F.col("l_tax").cast("double").alias("x3"),
        F.col("l_returnflag").alias("tag"),
        F.col("l_linestatus").alias("dataset"),
    )
    return long_values(li, DIMS, "tag", "dataset")


@query(
    "agg01_vector_statistics",
    "AGG-01 SRC-21",
    f"WITH {LF}, {LONG} SELECT dim, count(*) AS n, {six_sql()} FROM lv GROUP BY dim",
)
def _(spark, sf):
    return S.column_statistics(long_lines(spark, sf), ["dim"]).select("dim", "n", *six())


@query(
    "agg02_statistics_skip_nan",
    "AGG-02 FLT-09 FLT-10",
    f"""WITH {LF}, v AS (SELECT *, x2 = 0.05 AS bad, x3 = 0.04 AS absent FROM lf),
    u AS (SELECT unnest([0, 1]) AS dim, unnest([x0, x2]) AS value FROM v WHERE NOT bad AND NOT absent)
    SELECT dim, count(*) AS n, {six_sql()} FROM u GROUP BY dim""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_quantity").cast("double").alias("q"),
        F.col("l_discount").cast("double").alias("d"),
        F.col("l_tax").cast("double").alias("t"),
    )
    nan = F.lit(float("nan"))
    v = F.array("q", F.when(F.col("d") == 0.05, nan).otherwise(F.col("d")))
    rows = li.select(F.when(F.col("t") != 0.04, v).alias("state"), F.lit("x").alias("annotation.a"))
    cols = S.summarised_columns(rows.columns)
    good = S.drop_bad_vectors(rows.select(*cols), "state")
    out = S.column_statistics(S.explode_vector(good, "state"), ["dim"])
    return out.select("dim", "n", *six())


def _sampled(window, k, seed):
    return f"""n AS (SELECT episode, count(*) AS n FROM pf GROUP BY 1),
    st AS (SELECT episode, unnest(range(0, n - {window} + 1)) AS start FROM n WHERE n >= {window}),
    pick AS (SELECT *, row_number() OVER (PARTITION BY episode
      ORDER BY {u_sql(str(seed), "episode", "start")}, start) AS rn FROM st)"""


@query(
    "agg03_window_delta_statistics",
    "AGG-03 SMP-11 FLT-11",
    f"""WITH {_delta_sql()}, {_sampled(4, 2, 1234)},
    u AS (SELECT d.* FROM pick p JOIN rel d ON d.episode = p.episode
      AND d.frame BETWEEN p.start + 1 AND p.start + 3 WHERE p.rn <= 2),
    l AS (SELECT unnest([0,1,2,3,4,5]) AS dim, unnest([tx,ty,tz,rr,rp,ry]) AS value FROM u)
    SELECT dim, count(*) AS n, {R("avg(value)")} AS mean, {R("stddev_pop(value)")} AS std,
      {R("least(min(value), 0)")} AS min, {R("greatest(max(value), 0)")} AS max,
      {R("quantile_cont(value, 0.01)")} AS q01, {R("quantile_cont(value, 0.99)")} AS q99
    FROM l GROUP BY dim""",
)
def _(spark, sf):
    out = S.delta_statistics(
        pose_frames(spark, sf), "episode", "frame", POSE6, window=4, samples=2, anchor_zero=True
    )
    return out.select("dim", "n", *six(6))


STAT_CTE = f"""ds AS (SELECT l_returnflag AS tag, l_linestatus AS dataset, dim, avg(value) AS mean,
    stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
    quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99, count(*) AS n
  FROM (SELECT l_returnflag, l_linestatus, unnest([0,1,2,3]) AS dim,
      unnest([x0, x1, x2, x3]) AS value FROM lf) GROUP BY 1, 2, 3)"""


def _merge_sql(quantiles: str) -> str:
    return f"""WITH {LF}, {STAT_CTE}, w AS (SELECT *, n / sum(n) OVER (PARTITION BY tag, dim) AS w FROM ds)
    SELECT tag, dim, {R("sum(w * mean)", 4)} AS mean,
      {R("sqrt(sum(w * (std * std + mean * mean)) - sum(w * mean) ** 2)", 4)} AS std,
      {R("min(min)", 4)} AS min, {R("max(max)", 4)} AS max, {quantiles}, count(*) AS n_datasets
    FROM w GROUP BY tag, dim"""


def _merged(spark, sf, method):
    rows = long_lines(spark, sf)
    stats = S.column_statistics(rows, ["tag", "dataset", "dim"])
    stats = stats.withColumn("dataset", F.concat_ws("/", "tag", "dataset"))
    li = table(spark, sf, "lineitem")
    weights = li.groupBy(F.concat_ws("/", "l_returnflag", "l_linestatus").alias("dataset")).agg(
        F.count(F.lit(1)).alias("weight"))
    return S.merge_statistics(
        stats.drop("n"), weights, "dataset", ["dim"], method, group=["tag"]
    ).select("tag", "dim", *six(), "n_datasets")


query(
    "agg04_merge_weighted_average",
    "AGG-04 AGG-05",
    _merge_sql(f"{R('sum(w * q01)', 4)} AS q01, {R('sum(w * q99)', 4)} AS q99"),
)(lambda spark, sf: _merged(spark, sf, "weighted_average"))
query(
    "agg04_merge_min_max",
    "AGG-04 AGG-05",
    _merge_sql(f"{R('min(q01)', 4)} AS q01, {R('max(q99)', 4)} AS q99"),
)(lambda spark, sf: _merged(spark, sf, "min_max"))


@query(
    "agg05_config_agreement",
    "AGG-05",
    """SELECT p_brand AS tag, p_type AS key, count(DISTINCT p_size) AS n_configs
    FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_size) > 1""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_brand").alias("tag"), F.col("p_type").alias("key"), "p_size"
    )
    return S.config_agreement(p, "tag", "key", "p_size")


@query(
    "agg06_combine_key_statistics",
    "AGG-06 SNK-06 SRT-02",
    f"""WITH {LF}, {STAT_CTE}, k AS (SELECT *, dataset || CASE WHEN dim = 3 THEN '.gripper'
        ELSE '.joint' END AS key FROM ds)
    SELECT tag, (row_number() OVER (PARTITION BY tag ORDER BY key LIKE '%gripper', dataset, dim) - 1)::INTEGER
      AS pos, {R("mean", 4)} AS mean, {R("q99", 4)} AS q99, NOT key LIKE '%gripper' AS mask FROM k""",
)
def _(spark, sf):
    stats = S.column_statistics(long_lines(spark, sf), ["tag", "dataset", "dim"])
    key = F.concat(
        "dataset", F.when(F.col("dim") == 3, F.lit(".gripper")).otherwise(F.lit(".joint"))
    )
    stats = stats.withColumn("key", key)
    order = F.struct(F.col("key").contains("gripper"), F.col("dataset"))
    out = S.combine_keys(stats.withColumn("ord", order), "tag", "key", "ord", "dim")
    out = out.select("tag", F.posexplode(F.arrays_zip("mean", "q99", "mask")).alias("pos", "s"))
    return out.select("tag", "pos", r(F.col("s.mean"), 4).alias("mean"),
                      r(F.col("s.q99"), 4).alias("q99"), F.col("s.mask").alias("mask"))


@query(
    "agg07_dataset_counts",
    "AGG-07",
    """WITH e AS (SELECT o.o_orderpriority AS tag, o.o_orderkey, count(*) AS n FROM orders o
      JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2)
    SELECT tag, sum(n)::BIGINT AS num_transitions, count(*) AS num_trajectories FROM e GROUP BY 1""",
)
def _(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("tag"))
    return S.dataset_counts(n.join(o, F.col("l_orderkey") == F.col("o_orderkey")), "tag", "n")


@query(
    "agg12_calibrate_thresholds",
    "AGG-12",
    f"""SELECT event_type, {R("quantile_cont(value, 0.5)")} AS tau_soft,
      {R("quantile_cont(value, 0.9)")} AS tau_hard FROM events GROUP BY 1""",
)
def _(spark, sf):
    out = S.calibrate_thresholds(table(spark, sf, "events"), ["event_type"], F.col("value"))
    return out.select(
        "event_type", r(F.col("tau_soft")).alias("tau_soft"), r(F.col("tau_hard")).alias("tau_hard")
    )


GLOBAL = """g AS (SELECT dim, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min,
    max(value) AS max, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99
  FROM lv GROUP BY dim)"""
# the sixth dimension is constant, so its statistics are degenerate
GLOBAL_C = """lv AS (SELECT episode, frame, unnest([0,1,2,3,4]) AS dim,
    unnest([x0, x1, x2, x3, 7.0::DOUBLE]) AS value FROM lf)"""
FORWARD = {
    "q99": "greatest(least(CASE WHEN q01 <> q99 THEN 2 * ((value - q01) / (q99 - q01)) - 1 ELSE value END, 1), -1)",
    "mean_std": "CASE WHEN std <> 0 THEN (value - mean) / std ELSE value END",
    "min_max": "CASE WHEN min <> max THEN 2 * ((value - min) / (max - min)) - 1 ELSE 0.0 END",
    "scale": "CASE WHEN greatest(abs(min), abs(max)) <> 0 THEN value / greatest(abs(min), abs(max)) ELSE 0.0 END",
    "binary": "CASE WHEN value > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END",
}
INVERSE = {
    "q99": "(y + 1) / 2 * (q99 - q01) + q01",
    "mean_std": "y * std + mean",
    "min_max": "(y + 1) / 2 * (max - min) + min",
    "binary": "CASE WHEN y > 0.5 THEN 1.0::DOUBLE ELSE 0.0 END",
}


def _stats_row(spark, sf):
    cols = [*DIMS, "c"]
    li = table(spark, sf, "lineitem").select(
        *[F.col(c).cast("double").alias(a) for a, c in zip(
            DIMS, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])],
        F.lit(7.0).alias("c"),
    )
    return S.fit(S.column_statistics(long_values(li, cols), ["dim"]))


def _normalised(mode):
    def build(spark, sf):
        rows = line_frames(spark, sf).select(
            "episode", "frame", F.array(*DIMS, F.lit(7.0)).alias("v")
        )
        stats = _stats_row(spark, sf)
        rows = rows.withColumn("y", N.forward_vector(F.col("v"), stats, mode, 5))
        if mode in N.INVERTIBLE:
            rows = rows.withColumn("b", N.inverse_vector(F.col("y"), stats, mode, 5))
        else:
            rows = rows.withColumn("b", F.transform("y", lambda _: F.lit(None).cast("double")))
        out = rows.select("episode", "frame", F.posexplode(F.arrays_zip("y", "b")).alias("dim", "p"))
        return out.select("episode", "frame", "dim", r(F.col("p.y"), 5).alias("y"),
                          r(F.col("p.b"), 3).alias("back"))

    return build


for _mode in N.MODES:
    _back = R(INVERSE[_mode], 3) if _mode in INVERSE else "NULL::DOUBLE"
    query(
        f"fn13_normalise_{_mode}",
        "FN-13 FN-14 JN-11 UDF-01",
        f"""WITH {LF}, {GLOBAL_C}, {GLOBAL},
        f AS (SELECT episode, frame, dim, g.*, {FORWARD[_mode]} AS y FROM lv JOIN g USING (dim))
        SELECT episode, frame, dim, {R("y", 5)} AS y, {_back} AS back FROM f""",
    )(_normalised(_mode))


UNMAP = "CASE WHEN m THEN 0.5 * (c + 1) * (hi - lo) + lo ELSE c END"


@query(
    "fn15_policy_unnormalise",
    "FN-15 FN-16",
    f"""WITH {LF}, u AS (SELECT episode, frame, unnest(range(7))::INTEGER AS i,
        unnest([x2 * 30 - 1.5, x3 * 30 - 1, x0 / 25 - 1, x2, x3, x0 / 50, x2 * 10]) AS a FROM lf),
    c AS (SELECT *, greatest(least(a, 1), -1) AS k, i % 3 <> 2 AS m, -1.0 - i AS lo, 2.0 + i AS hi
      FROM u),
    d AS (SELECT *, k AS c0, CASE WHEN i = 6 THEN CASE WHEN k < 0.5 THEN 0.0 ELSE 1.0 END ELSE k END AS c
      FROM c)
    SELECT episode, frame, i, {R(UNMAP)} AS by_quantile,
      {R(UNMAP.replace("(c ", "(c0 ").replace("ELSE c ", "ELSE c0 "))} AS by_range FROM d""",
)
def _(spark, sf):
    e = lambda s: F.expr(s).cast("double")
    rows = line_frames(spark, sf).select(
        "episode",
        "frame",
        F.array(*[e(s) for s in (
            "x2 * 30 - 1.5", "x3 * 30 - 1", "x0 / 25 - 1", "x2", "x3", "x0 / 50", "x2 * 10"
        )]).alias("v"),
    )
    lo = F.array(*[F.lit(-1.0 - i) for i in range(7)])
    hi = F.array(*[F.lit(2.0 + i) for i in range(7)])
    mask = F.array(*[F.lit(i % 3 != 2) for i in range(7)])
    q = N.policy_unnormalise(F.col("v"), lo, hi, mask, binary_dim=6)
    p = N.policy_unnormalise(F.col("v"), lo, hi, mask)
    out = rows.select("episode", "frame", F.posexplode(F.arrays_zip(q.alias("q"), p.alias("p"))).alias("i", "z"))
    return out.select("episode", "frame", "i", r(F.col("z.q")).alias("by_quantile"),
                      r(F.col("z.p")).alias("by_range"))


@query(
    "fn17_state_normalise",
    "FN-17",
    f"""WITH {LF}, {GLOBAL_C}, {GLOBAL} SELECT episode, frame, dim,
      {R('''CASE WHEN max = min THEN 0.0 ELSE greatest(least(
        (value - min) / (max - min + 1e-8) * 2 - 1, 1), -1) END''')} AS y FROM lv JOIN g USING (dim)""",
)
def _(spark, sf):
    stats = _stats_row(spark, sf)
    cols = [*[F.col(d) for d in DIMS], F.lit(7.0)]
    y = F.array(*[N.state_normalise(x, stats[i]["min"], stats[i]["max"]) for i, x in enumerate(cols)])
    out = line_frames(spark, sf).select("episode", "frame", F.posexplode(y).alias("dim", "y"))
    return out.withColumn("y", r(F.col("y")))


@query(
    "fn18_sin_cos",
    "FN-18",
    f"""WITH {LF} SELECT episode, frame, unnest(range(4))::INTEGER AS i,
      unnest([{R("sin(x0)")}, {R("sin(x2)")}, {R("cos(x0)")}, {R("cos(x2)")}]) AS y FROM lf""",
)
def _(spark, sf):
    out = line_frames(spark, sf).select(
        "episode", "frame", F.posexplode(V.sin_cos(F.array("x0", "x2"))).alias("i", "y")
    )
    return out.withColumn("y", r(F.col("y")))


# predictions: the truth shifted by small amounts that depend on the row
PRED = [f"{e}" for e in ("x0", "x2", "x3", "x0 / 8 - 3", "x2 * 50", "x3 * 60 - 2", "x2 * 10")]
GT14 = PRED + [f"({e}) + 0.25" for e in PRED]
PR14 = [f"({e}) + 0.1 * x3 * {i + 1} + 0.9 * x2" for i, e in enumerate(GT14)]


def _pair14(spark, sf, width):
    rows = line_frames(spark, sf, "l_returnflag")
    e = lambda s: F.expr(s).cast("double")
    extra = ["x0", "x2", "x3"]
    gt = (GT14 + extra)[:width]
    pr = (PR14 + [f"{x} * 1.5" for x in extra])[:width]
    truth = rows.select("episode", "frame", F.col("l_returnflag").alias("tag"),
                        F.array(*[e(s) for s in gt]).alias("gt"))
    preds = rows.select("episode", "frame", F.array(*[e(s) for s in pr], F.lit(0.0)).alias("pred"))
    return E.pair_predictions(truth, preds, ["episode", "frame"], "gt", "pred")


def _mae_sql(width):
    extra = ["x0", "x2", "x3"]
    gt = (GT14 + extra)[:width]
    pr = (PR14 + [f"{x} * 1.5" for x in extra])[:width]
    out = []
    groups = E.error_groups(width)
    for name in ("position", "orientation", "gripper", "hand"):
        if name not in groups:
            out.append(f"NULL::DOUBLE AS {name}_l1_loss")
            continue
        diffs = [f"({gt[d]}) - ({pr[d]})" for d in groups[name]]
        if name == "orientation":
            diffs = [wrap_sql(d) for d in diffs]
        body = " + ".join(f"abs({d})" for d in diffs)
        out.append(f"{R(f'avg(({body}) / {len(diffs)})')} AS {name}_l1_loss")
    return f"WITH {LF} SELECT l_returnflag AS tag, {', '.join(out)} FROM lf GROUP BY 1"


for _w in (12, 14, 17):
    query(f"agg13_grouped_mae_{_w}", "AGG-13 JN-16 FN-11", _mae_sql(_w))(
        lambda spark, sf, w=_w: E.grouped_mae(
            _pair14(spark, sf, w), ["tag"], F.col("gt"), F.col("pred"), w
        ).select("tag", *[r(F.col(f"{n}_l1_loss")).alias(f"{n}_l1_loss")
                          for n in ("position", "orientation", "gripper", "hand")])
    )

OL = f"""{LF}, ol AS (SELECT episode, frame AS h, sqrt((x2 - x3) ** 2 + (0.1 * x2) ** 2) AS l2
  FROM lf)"""


def _open_loop(spark, sf):
    rows = line_frames(spark, sf)
    return rows.select(
        "episode", F.col("frame").alias("h"), F.array("x2", "x3").alias("gt"),
        F.array(F.col("x3"), F.col("x3") + F.col("x2") * 0.1).alias("pred"),
    )


@query(
    "agg14_open_loop_steps",
    "AGG-14",
    f"""WITH {OL} SELECT h, {R("sum(l2) / (SELECT count(DISTINCT episode) FROM ol)")} AS mean_l2
    FROM ol GROUP BY h""",
)
def _(spark, sf):
    out = E.open_loop_steps(_open_loop(spark, sf), "episode", "h", "gt", "pred")
    return out.select("h", r(F.col("mean_l2")).alias("mean_l2"))


@query(
    "agg14_open_loop_summary",
    "AGG-14 SNK-12",
    f"""WITH {OL}, n AS (SELECT count(DISTINCT episode) AS n FROM ol),
    s AS (SELECT h, sum(l2) / max(n) AS m FROM ol, n GROUP BY h)
    SELECT {R("avg(m)")} AS ade, {R("arg_max(m, h)")} AS fde, max(n) AS n_samples,
      max(n) AS n_episodes FROM s, n""",
)
def _(spark, sf):
    out = E.open_loop_summary(_open_loop(spark, sf), "episode", "episode", "h", "gt", "pred")
    return out.select(r(F.col("ade")).alias("ade"), r(F.col("fde")).alias("fde"), "n_samples", "n_episodes")


@query(
    "agg15_success_rate",
    "AGG-15",
    f"""WITH e AS (SELECT user_id, min(event_type) AS kind, bool_or(value > 250) AS s, count(*) AS n
      FROM events GROUP BY user_id)
    SELECT user_id % 5 AS task, {R("avg(s::INTEGER)")} AS success_rate, {R("avg(n)")} AS mean_length,
      count(*) AS n_episodes FROM e GROUP BY 1""",
)
def _(spark, sf):
    ep = E.episode_success(table(spark, sf, "events"), ["user_id"], F.col("value") > 250)
    out = E.success_rate(ep.withColumn("task", F.col("user_id") % 5), "task")
    return out.select("task", r(F.col("success_rate")).alias("success_rate"),
                      r(F.col("mean_length")).alias("mean_length"), "n_episodes")


for _m, _f in (("max", "max"), ("min", "min"), ("mean", "avg"), ("sum", "sum")):
    query(
        f"agg16_reduce_steps_{_m}",
        "AGG-16",
        f"""WITH {EV} SELECT episode, frame // 8 AS macro_step, {R(f"{_f}(value)")} AS value
        FROM ev GROUP BY 1, 2""",
    )(
        lambda spark, sf, m=_m: E.reduce_steps(
            signal_frames(spark, sf), ["episode"], "frame", "value", 8, m
        ).withColumn("value", r(F.col("value")))
    )


@query(
    "agg17_batch_health",
    "AGG-17 FN-40",
    f"""WITH {LF}, {LONG} SELECT episode, {R("stddev_samp(value)", 4)} AS std
    FROM lv GROUP BY episode""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("episode"),
        *[F.col(c).cast("double").alias(a) for a, c in zip(
            DIMS, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])],
    )
    out = E.batch_health(long_values(li, DIMS, "episode"), ["episode"])
    return out.select("episode", r(F.col("std"), 4).alias("std"))


@query(
    "agg18_run_summary",
    "AGG-18",
    f"""WITH {EV}, t AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY frame DESC) AS rn FROM ev)
    SELECT episode, {R("min(value)")} AS best_loss, {R("avg(value) FILTER (rn <= 50)")} AS mean_last,
      {R("arg_max(value, frame)")} AS final_loss, count(*) AS n_steps FROM t GROUP BY 1""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("episode"), F.struct("ts", "event_id").alias("step"), "value"
    )
    out = E.run_summary(ev, "episode", "step", "value")
    return out.select("episode", *[r(F.col(c)).alias(c) for c in ("best_loss", "mean_last", "final_loss")],
                      "n_steps")


@query(
    "agg19_embedding_health",
    "AGG-19",
    f"""WITH e AS (SELECT label, vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS x,
        sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS nrm FROM embeddings),
    p AS (SELECT a.label, sum(a.x / a.nrm * b.x / b.nrm) AS s FROM e a JOIN e b
      ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id GROUP BY 1),
    n AS (SELECT label, count(DISTINCT vec_id) AS n, avg(nrm) AS m FROM e GROUP BY 1)
    SELECT label, n, {R("m")} AS norm_mean, {R("s / (n * (n - 1))")} AS pairwise_cos
    FROM n JOIN p USING (label)""",
)
def _(spark, sf):
    out = E.embedding_health(table(spark, sf, "embeddings"), ["label"], "embedding")
    return out.select("label", "n", r(F.col("norm_mean")).alias("norm_mean"),
                      r(F.col("pairwise_cos")).alias("pairwise_cos"))


@query(
    "agg20_masked_losses",
    "AGG-20",
    f"""WITH p AS (SELECT d.lang, l.quality::DOUBLE AS y, (d.n_chars % 17 - 8) / 4.0 AS z,
        (l.toxic = 0)::INTEGER AS m FROM documents d JOIN labels l USING (doc_id))
    SELECT lang, {R("sum(m * (z - y) ** 2) / greatest(sum(m), 1e-8)")} AS mse,
      {R("sum(m * (greatest(z, 0) - z * y + ln(1 + exp(-abs(z))))) / greatest(sum(m), 1e-8)")} AS bce
    FROM p GROUP BY lang""",
)
def _(spark, sf):
    p = table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(
        table(spark, sf, "labels"), "doc_id")
    z = (F.col("n_chars") % 17 - 8) / F.lit(4.0)
    y, m = F.col("quality").cast("double"), F.col("toxic") == 0
    return p.groupBy("lang").agg(r(E.masked_mse(z, y, m)).alias("mse"), r(E.masked_bce(z, y, m)).alias("bce"))


@query(
    "agg21_batch_composition",
    "AGG-21 FN-37",
    f"""SELECT l_orderkey % 64 AS batch, l_returnflag AS task, l_linestatus AS tag, count(*) AS n,
      count(DISTINCT (round(l_discount, 4), round(l_tax, 4), round(l_quantity, 4))) AS n_distinct
    FROM lineitem GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    v = F.array(*[F.col(c).cast("double") for c in ("l_discount", "l_tax", "l_quantity")])
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 64).alias("batch"), F.col("l_returnflag").alias("task"),
        F.col("l_linestatus").alias("tag"), fingerprint(v, F.lit("")).alias("fp"),
    )
    return E.batch_composition(li, "batch", "task", "tag", "fp")


@query(
    "agg23_metric_averages",
    "AGG-23",
    f"""WITH t AS (SELECT l_returnflag AS tag, l_orderkey, avg(l_discount) AS a,
        CASE WHEN count(*) > 2 THEN avg(l_tax) END AS b FROM lineitem GROUP BY 1, 2)
    SELECT tag, {R("avg(a)")} AS a, {R("avg(b)")} AS b, count(*) AS n_trajectories
    FROM t GROUP BY ROLLUP (tag)""",
)
def _(spark, sf):
    t = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("tag"), "l_orderkey").agg(
        F.avg("l_discount").alias("a"), F.when(F.count(F.lit(1)) > 2, F.avg("l_tax")).alias("b"))
    out = E.averages_with_total(t, "tag", "a", "b")
    return out.select("tag", r(F.col("a")).alias("a"), r(F.col("b")).alias("b"), "n_trajectories")


@query(
    "agg25_action_distance",
    "AGG-25",
    f"""SELECT l_orderkey % 64 AS batch, {R('''sqrt(sum((l_discount - l_tax) ** 2
      + (l_quantity - l_discount) ** 2)) / (2 * count(*))''')} AS mean_distance FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") % 64).alias("batch"),
        F.array(F.col("l_discount").cast("double"), F.col("l_quantity").cast("double")).alias("gt"),
        F.array(F.col("l_tax").cast("double"), F.col("l_discount").cast("double")).alias("pred"))
    out = E.mean_action_distance(li, ["batch"], "gt", "pred")
    return out.select("batch", r(F.col("mean_distance")).alias("mean_distance"))


@query(
    "fn36_box_iou",
    "FN-36 AGG-25",
    f"""WITH {LF}, b AS (SELECT episode, frame, x0 AS ax, x2 * 100 AS ay, x0 + 10 AS bx,
        x2 * 100 + 5 AS by_, x0 + x3 * 50 AS cx, x2 * 100 + x3 * 20 AS cy,
        x0 + x3 * 50 + 8 AS dx, x2 * 100 + x3 * 20 + 6 AS dy FROM lf),
    i AS (SELECT *, greatest(least(bx, dx) - greatest(ax, cx), 0)
        * greatest(least(by_, dy) - greatest(ay, cy), 0) AS inter FROM b)
    SELECT episode, frame, {R("inter / (50 + 48 - inter)")} AS iou FROM i""",
)
def _(spark, sf):
    e = F.expr
    a = [e("x0"), e("x2 * 100"), e("x0 + 10"), e("x2 * 100 + 5")]
    b = [e("x0 + x3 * 50"), e("x2 * 100 + x3 * 20"), e("x0 + x3 * 50 + 8"), e("x2 * 100 + x3 * 20 + 6")]
    return line_frames(spark, sf).select("episode", "frame", r(box_iou(a, b)).alias("iou"))


PAIRS = """nx AS (SELECT a.vec_id, a.label, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""


def _neighbours(spark, sf):
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.select("vec_id", "label", F.col("embedding").alias("a")).join(nxt, "vec_id")


@query(
    "agg26_soft_spearman",
    "AGG-26 JN-18",
    f"""WITH {PAIRS}, u AS (SELECT vec_id, unnest(range(64)) AS i, unnest(a) AS x, unnest(b) AS y FROM nx),
    rk AS (SELECT p.vec_id, p.i, 0.5 + sum(1 / (1 + exp((p.x - q.x) / 0.05))) AS rx,
        0.5 + sum(1 / (1 + exp((p.y - q.y) / 0.05))) AS ry
      FROM u p JOIN u q USING (vec_id) GROUP BY 1, 2),
    c AS (SELECT vec_id, rx - avg(rx) OVER (PARTITION BY vec_id) AS rx,
        ry - avg(ry) OVER (PARTITION BY vec_id) AS ry FROM rk)
    SELECT vec_id, {R("sum(rx * ry) / sqrt((sum(rx * rx) + 1e-8) * (sum(ry * ry) + 1e-8))")} AS rho
    FROM c GROUP BY 1""",
)
def _(spark, sf):
    rows = _neighbours(spark, sf)
    return rows.select("vec_id", r(E.soft_spearman(F.col("a"), F.col("b"), tau=0.05)).alias("rho"))


@query(
    "agg29_info_nce",
    "AGG-29",
    f"""WITH {PAIRS}, n AS (SELECT vec_id, vec_id // 50 AS batch, a, b FROM nx),
    l AS (SELECT s.batch, s.vec_id AS i, t.vec_id AS j, list_dot_product(s.a, t.b)
        / (sqrt(list_dot_product(s.a, s.a)) * sqrt(list_dot_product(t.b, t.b))) / 0.07 AS z
      FROM n s JOIN n t USING (batch)),
    r1 AS (SELECT batch, i, ln(sum(exp(z))) - max(z) FILTER (i = j) AS e FROM l GROUP BY 1, 2),
    r2 AS (SELECT batch, j, ln(sum(exp(z))) - max(z) FILTER (i = j) AS e FROM l GROUP BY 1, 2)
    SELECT batch, n, {R("0.5 * (e1 + e2)")} AS loss
    FROM (SELECT batch, avg(e) AS e1, count(*) AS n FROM r1 GROUP BY 1)
    JOIN (SELECT batch, avg(e) AS e2 FROM r2 GROUP BY 1) USING (batch)""",
)
def _(spark, sf):
    rows = _neighbours(spark, sf).withColumn("batch", F.floor(F.col("vec_id") / 50))
    out = E.info_nce(rows, "batch", "vec_id", "a", "b", batch_rows=50)
    return out.withColumn("loss", r(F.col("loss")))


@query(
    "agg29_paired_mse",
    "AGG-29",
    f"""WITH {PAIRS}, u AS (SELECT label, unnest(a) AS x, unnest(b) AS y FROM nx)
    SELECT label, {R("avg((x - y) ** 2)")} AS mse FROM u GROUP BY 1""",
)
def _(spark, sf):
    out = E.paired_mse(_neighbours(spark, sf), ["label"], "a", "b")
    return out.select("label", r(F.col("mse")).alias("mse"))


@query(
    "agg28_channel_order",
    "AGG-28",
    f"""WITH e AS (SELECT label, embedding::DOUBLE[] AS v,
        row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame,
        count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    m AS (SELECT label, v FROM e WHERE frame = n // 2),
    u AS (SELECT label, unnest(range(63)) AS i, unnest(v[1:63]) * 128 + 128 AS x FROM m),
    g AS (SELECT label, avg(x) FILTER (i % 3 = 0) - avg(x) FILTER (i % 3 = 2) AS gap FROM u GROUP BY 1)
    SELECT label, {R("gap")} AS gap, CASE WHEN abs(gap) < 5 THEN 'ambiguous'
      WHEN gap > 0 THEN 'swap' ELSE 'keep' END AS status FROM g""",
)
def _(spark, sf):
    from epispark.scale import dense_index

    e = dense_index(table(spark, sf, "embeddings"), ["label"], ["vec_id"],
                    [F.floor(F.col("vec_id") / 4096)])
    pix = F.transform(
        F.sequence(F.lit(0), F.lit(20)),
        lambda i: F.transform(
            F.slice("embedding", i * 3 + 1, 3), lambda x: x.cast("double") * 128 + 128
        ),
    )
    out = E.channel_order(e.select("label", "frame", pix.alias("pixels")), ["label"], "frame", "pixels")
    return out.select("label", r(F.col("gap")).alias("gap"), "status")


@query("agg30_principal_components", "AGG-30")
def _(spark, sf):
    out = E.principal_components(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", 64)
    return out.select("label", "vec_id", *[r(F.col(c), 4).alias(c) for c in ("pc0", "pc1", "pc2")])


@query(
    "agg31_percentile_clip",
    "AGG-31",
    f"""WITH v AS (SELECT event_id, event_type, CASE WHEN value < 20 THEN 0 ELSE value END AS x FROM events),
    q AS (SELECT event_type, quantile_cont(x, 0.02) AS lo, quantile_cont(x, 0.98) AS hi
      FROM v WHERE x > 0 GROUP BY 1)
    SELECT event_id, {R('''coalesce(least(greatest((x - lo) / greatest(hi - lo, 1e-3), 0), 1), 0)''')}
      AS scaled FROM v LEFT JOIN q USING (event_type)""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", "event_type",
        F.when(F.col("value") < 20, F.lit(0.0)).otherwise(F.col("value")).alias("x"))
    out = S.percentile_clip_normalise(ev, ["event_type"], "x")
    return out.select("event_id", r(F.col("scaled")).alias("scaled"))


@query(
    "flagship_canonical_health",
    "WIN-01 FN-10 FLT-07 AGG-01 FN-13 AGG-17",
    f"""WITH {PF}, d AS (SELECT episode, frame,
        coalesce(lead(px) OVER w - px, px - lag(px) OVER w, 0) * 15 AS vx,
        coalesce({wrap_sql("lead(pw) OVER w - pw")}, {wrap_sql("pw - lag(pw) OVER w")}, 0) * 15 AS vw,
        grip FROM pf WINDOW w AS (PARTITION BY episode ORDER BY frame)),
    c AS (SELECT episode, frame, greatest(least(vx, 2), -2) AS c0,
        greatest(least(vw, {PI}), -{PI}) AS c1, greatest(least(grip, 1), 0) AS c2 FROM d),
    l AS (SELECT episode, frame, unnest([0,1,2]) AS dim, unnest([c0, c1, c2]) AS value FROM c),
    s AS (SELECT dim, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99
      FROM l GROUP BY 1),
    y AS (SELECT episode, greatest(least(CASE WHEN q01 <> q99
        THEN 2 * ((value - q01) / (q99 - q01)) - 1 ELSE value END, 1), -1) AS y FROM l JOIN s USING (dim))
    SELECT episode, count(*) AS n, {R("stddev_samp(y)")} AS std FROM y GROUP BY episode""",
)
def _(spark, sf):
    v = W.finite_difference(pose_frames(spark, sf), ["episode"], "frame", ["px"], ["pw"], fps=15.0)
    zero = F.lit(0.0)
    canon = F.array("v_px", zero, zero, zero, zero, "v_pw", "grip")
    rows = v.select("episode", "frame", V.clip_canonical(canon).alias("a"))
    rows = rows.where(V.canonical_ok(F.col("a")))
    rows = rows.select("episode", *[F.col("a")[i].alias(f"c{j}") for j, i in enumerate((0, 5, 6))])
    # the canonical actions are a table of their own: written once, then read by both passes
    rows = materialise(rows, "canonical")
    names = ["c0", "c1", "c2"]
    stats = S.fit(S.column_statistics(long_values(rows, names), ["dim"]))
    scaled = rows.select(
        "episode", *[N.forward(F.col(c), stats[i], "q99").alias(c) for i, c in enumerate(names)])
    norm = long_values(scaled, names, "episode")
    return norm.groupBy("episode").agg(
        F.count(F.lit(1)).alias("n"), r(F.stddev_samp("value")).alias("std"))
