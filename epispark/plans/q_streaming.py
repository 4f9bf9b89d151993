"""Streaming and batch-replay queries (STR-*), model hooks and transforms (UDF-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.functions.ids import short_sha256
from epispark.operators import hooks as H
from epispark.operators.transforms import Compose, Concat, Normalise, StateAction, WindowConfig
from epispark.plans.q_stats import FORWARD, GLOBAL, _stats_row
from epispark.plans.registry import R, query, r
from epispark.plans.views import EV, LF, LONG, PF, line_frames, pose_frames, signal_frames, table
from epispark.session import scratch_path
from epispark.streaming import flows as FL
from epispark.streaming import trigger as TR

# the trigger as a recursion over frames: the row of a frame needs the last refresh before it
FSM = """r AS (
    SELECT episode, t, true AS fire, t AS last, 1::BIGINT AS n FROM x WHERE t = 0
    UNION ALL
    SELECT episode, t, f, CASE WHEN f THEN t ELSE last END, n + f::BIGINT FROM (
      SELECT x.episode, x.t, r.last, r.n, x.t - r.last >= 60 OR x.d > 0.5
        OR (x.d > 0.2 AND x.t - r.last >= 10) OR x.logit > 0 AS f
      FROM r JOIN x ON x.episode = r.episode AND x.t = r.t + 1))"""
REPLAY_SQL = f"""WITH RECURSIVE {EV},
  x AS (SELECT episode, frame AS t, value / 400 AS d, CASE WHEN event_type = 'signup' AND value > 150 THEN 1.0 ELSE -1.0 END AS logit FROM ev),
  {FSM}
  SELECT episode, t, fire AS refreshed, n AS refresh_count FROM r"""
CONFIG = TR.TriggerConfig(tau_hard=0.5, tau_soft=0.2, timer_hard=60, timer_soft=10)


def trigger_rows(spark, sf):
    logit = F.when((F.col("event_type") == "signup") & (F.col("value") > 150), 1.0).otherwise(-1.0)
    return signal_frames(spark, sf).select(
        "episode", F.col("frame").alias("t"), (F.col("value") / 400).alias("drift"), logit.alias("logit"))


def _replay(size):
    def build(spark, sf):
        out = TR.refresh_batch(
            trigger_rows(spark, sf), "episode", "t", F.col("logit"), drift=F.col("drift"), config=CONFIG, size=size)
        return out.select("episode", "t", "refreshed", "refresh_count")

    return build


query("str01_refresh_batch", "STR-01 FN-25", REPLAY_SQL)(_replay(TR.BLOCK))
query("str01_refresh_batch_blocked", "STR-01", REPLAY_SQL)(_replay(60))


@query("str01_refresh_stream", "STR-01 STR-02 STR-06", REPLAY_SQL)
def _(spark, sf):
    src = scratch_path(spark, "frames")
    trigger_rows(spark, sf).repartition("episode").write.parquet(src)
    schema = spark.read.parquet(src).schema
    stream = FL.file_stream(spark, src, schema)
    out = FL.run_to_table(TR.refresh_stream(stream, CONFIG), scratch_path(spark, "out"), scratch_path(spark, "ckpt"))
    return out.select("episode", "t", "refreshed", "refresh_count")


VEC = """v AS (SELECT label::BIGINT AS episode, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding::DOUBLE[] AS e FROM embeddings)"""


@query(
    "str01_refresh_vector",
    "STR-01 FN-24",
    f"""WITH RECURSIVE {VEC}, r AS (
      SELECT episode, t, true AS fire, t AS last, e AS c, NULL::DOUBLE AS d, 1::BIGINT AS n FROM v WHERE t = 0
      UNION ALL
      SELECT episode, t, f, CASE WHEN f THEN t ELSE last END, CASE WHEN f THEN e ELSE c END, d, n + f::BIGINT FROM (
        SELECT *, t - last >= 60 OR d > 1.2 OR (d > 0.9 AND t - last >= 5) AS f FROM (
          SELECT v.episode, v.t, v.e, r.last, r.c, r.n, 1 - list_dot_product(v.e, r.c)
            / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(r.c, r.c))) AS d
          FROM r JOIN v ON v.episode = r.episode AND v.t = r.t + 1)))
    SELECT episode, t, fire AS refreshed, {R("d")} AS drift, n AS refresh_count FROM r""",
)
def _(spark, sf):
    from epispark.scale import dense_index, key_prefix, order_buckets

    e = table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("episode"), "vec_id", "embedding")
    rows = dense_index(e, ["episode"], ["vec_id"], key_prefix(order_buckets(e, F.col("vec_id"), keys=["episode"])), "t")
    cfg = TR.TriggerConfig(tau_hard=1.2, tau_soft=0.9, timer_hard=60, timer_soft=5)
    out = TR.refresh_batch(rows, "episode", "t", F.lit(-1.0), vector=F.col("embedding"), config=cfg)
    return out.select("episode", "t", "refreshed", r(F.col("drift")).alias("drift"), "refresh_count")


@query(
    "str03_ensemble_stream",
    "STR-03 WIN-12",
    f"""WITH {EV}, p AS (SELECT episode, frame AS t0, i, frame + i AS t, [value / 50 + i, 5.0 - i * value / 100] AS v
      FROM ev CROSS JOIN (SELECT unnest(range(4)) AS i)),
    rf AS (SELECT episode, t, v AS ref FROM p WHERE i = 0),
    w AS (SELECT p.*, exp(1.5 * (list_dot_product(v, ref) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(ref, ref)) + 1e-7))) AS w
      FROM p JOIN rf USING (episode, t))
    SELECT episode, t, count(*)::INTEGER AS n_preds, {R("sum(w * v[1]) / sum(w)")} AS a0, {R("sum(w * v[2]) / sum(w)")} AS a1 FROM w GROUP BY 1, 2""",
)
def _(spark, sf):
    x = F.col("value")
    chunk = F.array(*[F.array(x / 50 + i, 5.0 - i * x / 100) for i in range(4)])
    src = scratch_path(spark, "chunks")
    rows = signal_frames(spark, sf).select("episode", F.col("frame").alias("t"), chunk.alias("chunk"))
    rows.repartition("episode").write.parquet(src)
    stream = FL.file_stream(spark, src, spark.read.parquet(src).schema)
    out = FL.run_to_table(TR.ensemble_stream(stream, 4, 1.5), scratch_path(spark, "out"), scratch_path(spark, "ckpt"))
    return out.select("episode", "t", "n_preds", r(F.col("action")[0]).alias("a0"), r(F.col("action")[1]).alias("a1"))


@query("str04_resumable_ingest", "STR-04 SNK-04",
       "SELECT event_id, user_id, 1::BIGINT AS copies FROM events")
def _(spark, sf):
    src, out = scratch_path(spark, "raw"), scratch_path(spark, "out")
    ledger, ckpt = scratch_path(spark, "ledger"), scratch_path(spark, "ckpt")
    ev = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("episode_index"), F.lit("events").alias("source"))
    schema = ev.schema
    same = lambda df: df
    # two arrivals with a stop between them; the second brings some episodes again, and a third run
    # with a fresh checkpoint folder sees all files once more
    some = lambda df, p: df.where(p).repartition(4, "episode_index").write.mode("append").parquet(src)
    some(ev, "episode_index % 2 = 0")
    FL.ingest(FL.file_stream(spark, src, schema, files_per_trigger=2), same, out, ledger, ckpt)
    some(ev, "episode_index % 2 = 1 OR episode_index % 4 = 0")
    FL.ingest(FL.file_stream(spark, src, schema, files_per_trigger=2), same, out, ledger, ckpt)
    FL.ingest(FL.file_stream(spark, src, schema), same, out, ledger, scratch_path(spark, "ckpt"))
    back = spark.read.parquet(out)
    return back.groupBy("event_id", F.col("episode_index").alias("user_id")).agg(F.count(F.lit(1)).alias("copies"))


@query("str05_watch_folder", "STR-05 SNK-10",
       "SELECT user_id % 8 AS part, 1::BIGINT AS seen FROM events GROUP BY 1")
def _(spark, sf):
    src, sent = scratch_path(spark, "watched"), scratch_path(spark, "sent")
    ev = table(spark, sf, "events").withColumn("part", F.col("user_id") % 8)
    ev.repartition("part").write.partitionBy("part").parquet(src)

    def publish(files, number):
        files.select("path", "length").write.mode("append").parquet(sent)

    ckpt = scratch_path(spark, "ckpt")
    for _ in range(2):  # the second run finds nothing new
        FL.watch_folder(spark, src, ckpt, publish, "*.parquet", every=None).awaitTermination()
    part = F.regexp_extract("path", r"part=(\d+)/", 1).cast("long")
    return spark.read.parquet(sent).groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("seen"))


@query("str07_drop_repeats", "STR-07",
       "SELECT DISTINCT substr(sha256(event_type || '/' || value), 1, 12) AS hash FROM events")
def _(spark, sf):
    src = scratch_path(spark, "hashes")
    ev = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("at"),
        short_sha256(F.concat_ws("/", "event_type", F.col("value").cast("string"))).alias("hash"))
    ev.write.parquet(src)
    stream = FL.drop_repeats(FL.file_stream(spark, src, ev.schema), "at", ["hash"], "60 days")
    out = FL.run_to_table(stream, scratch_path(spark, "out"), scratch_path(spark, "ckpt"))
    return out.select("hash")


@query(
    "str08_live_metrics",
    "STR-08",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, user_id, value, event_type FROM events
      UNION ALL SELECT time_bucket(INTERVAL 1 HOUR, ts), user_id, value, event_type FROM events WHERE false),
    wm AS (SELECT max(ts) - INTERVAL 10 MINUTE AS t FROM events)
    SELECT epoch_us(h) AS window_us, user_id, count_if(event_type = 'signup')::BIGINT AS refresh_count,
      {R("avg(value)")} AS mean_drift, count(*) AS n_steps
    FROM w, wm WHERE h + INTERVAL 1 HOUR <= wm.t GROUP BY 1, 2""",
)
def _(spark, sf):
    src = scratch_path(spark, "steps")
    ev = table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("at"), "user_id", "value", "event_type")
    ev.write.parquet(src)
    stream = FL.live_metrics(
        FL.file_stream(spark, src, ev.schema), "at", "user_id", F.col("event_type") == "signup", F.col("value"))
    out = FL.run_to_table(stream, scratch_path(spark, "out"), scratch_path(spark, "ckpt"))
    return out.select(F.unix_micros("window_start").alias("window_us"), "user_id", "refresh_count",
                      r(F.col("mean_drift")).alias("mean_drift"), "n_steps")


@query(
    "str08_batch_metrics",
    "STR-08",
    f"""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, user_id,
      count_if(event_type = 'signup')::BIGINT AS refresh_count, {R("avg(value)")} AS mean_drift, count(*) AS n_steps
    FROM events GROUP BY 1, 2""",
)
def _(spark, sf):
    """The same operator over the finished table: all windows, the last ones included."""
    ev = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    out = FL.live_metrics(ev, "at", "user_id", F.col("event_type") == "signup", F.col("value"))
    return out.select(F.unix_micros("window_start").alias("window_us"), "user_id", "refresh_count",
                      r(F.col("mean_drift")).alias("mean_drift"), "n_steps")


# ---- transforms and hooks -----------------------------------------------------------------


@query(
    "udf01_transform_chain",
    "UDF-01 UDF-02 PRJ-08 FN-13 FN-14",
    f"""WITH {LF}, {LONG}, {GLOBAL}, y AS (SELECT episode, frame, dim, value, {FORWARD["min_max"]} AS y FROM lv JOIN g USING (dim))
    SELECT episode, frame, dim, {R("y", 5)} AS y, {R("value", 3)} AS back FROM y""",
)
def _(spark, sf):
    stats = _stats_row(spark, sf)
    chain = Compose([
        Normalise("arm", "min_max", F.slice("stats", 1, 2)),
        Normalise("rest", "min_max", F.slice("stats", 3, 2)),
        Concat("vector", {"arm": 2, "rest": 2}),
    ])
    rows = line_frames(spark, sf).select(
        "episode", "frame", F.array("x0", "x1").alias("arm"), F.array("x2", "x3").alias("rest"), stats.alias("stats"))
    done = chain.apply(rows)
    back = chain.unapply(done.withColumn("y", F.col("vector")))
    both = F.arrays_zip("y", F.concat("arm", "rest").alias("b"))
    out = back.select("episode", "frame", F.posexplode(both).alias("dim", "z"))
    return out.select("episode", "frame", "dim", r(F.col("z.y"), 5).alias("y"), r(F.col("z.b"), 3).alias("back"))


@query(
    "udf02_rotation_normalise",
    "UDF-02 FN-21",
    f"""WITH {LF} SELECT episode, frame, {R("cos(x3 * 10) * cos(x2 * 5)", 5)} AS r0,
      {R("cos(x2 * 5) * sin(x3 * 10)", 5)} AS r3 FROM lf""",
)
def _(spark, sf):
    t = StateAction("rot", "euler_angles_ypr", "rotation_6d", mode="min_max", bounds=(-1.0, 1.0))
    rows = line_frames(spark, sf).select(
        "episode", "frame", F.array(F.col("x3") * 10, F.col("x2") * 5, F.col("x0") / 20).alias("rot"))
    out = t.apply(rows)
    return out.select("episode", "frame", r(F.col("rot")[0], 5).alias("r0"), r(F.col("rot")[3], 5).alias("r3"))


@query(
    "udf06_batch_model",
    "UDF-06 UDF-08 SNK-12",
    f"""WITH {LF} SELECT episode, frame, {R("x2 + x3", 5)} AS pred, 0.0::DOUBLE AS untrained FROM lf""",
)
def _(spark, sf):
    def model():
        import numpy as np

        return lambda x: np.sum(x, axis=1, keepdims=True)

    rows = line_frames(spark, sf).select("episode", "frame", F.array("x2", "x3").cast("array<float>").alias("x"))
    out = rows.select("episode", "frame", H.predict(F.col("x"), 2, 1, model).alias("p"),
                      H.predict(F.col("x"), 2, 1, None).alias("z"))
    return out.select("episode", "frame", r(F.col("p")[0].cast("double"), 5).alias("pred"),
                      r(F.col("z")[0].cast("double")).alias("untrained"))


@query(
    "udf07_feature_encoding",
    "UDF-07 SRT-07 SRT-08",
    f"""WITH {EV} SELECT episode, frame // 3 AS feat_idx, i::INTEGER AS pos, {R("value * (i + 1)", 2)} AS x
    FROM ev CROSS JOIN (SELECT unnest(range(3)) AS i) WHERE frame % 3 = 0""",
)
def _(spark, sf):
    def model():
        import numpy as np

        return lambda x: x @ np.arange(1, 6, dtype=np.float32)[None, :]

    frames = signal_frames(spark, sf).select("episode", "frame", F.array("value").cast("array<float>").alias("x"))
    out = H.encode_features(frames, "frame", "x", 1, tokens=5, token_dim=1, src_fps=15, dst_fps=5, patches=2, model=model)
    out = out.select("episode", "feat_idx", F.posexplode("tokens").alias("pos", "t"))
    return out.select("episode", "feat_idx", "pos", r(F.col("t")[0].cast("double"), 2).alias("x"))


@query(
    "udf09_window_config",
    "UDF-09 WIN-04 WIN-05",
    f"""WITH {EV}, n AS (SELECT episode, count(*) AS n FROM ev GROUP BY 1),
    o AS (SELECT unnest(['history', 'action']) AS key, unnest([-2, 1]) AS off)
    SELECT f.episode, f.frame, o.key, {R("g.value")} AS value, f.frame + o.off BETWEEN 0 AND n.n - 1 AS valid
    FROM ev f JOIN n USING (episode) CROSS JOIN o
    JOIN ev g ON g.episode = f.episode AND g.frame = least(greatest(f.frame + o.off, 0), n.n - 1)
    WHERE f.frame % 3 = 0""",
)
def _(spark, sf):
    cfg = WindowConfig(values={"v": "value"}, offsets={"history": [-2], "action": [1]}, interval=3)
    out = cfg.plan(signal_frames(spark, sf), ["episode"], "frame")
    items = F.array(*[
        F.struct(F.lit(k).alias("key"), F.col(f"{k}_v")[0].alias("value"), F.col(f"{k}_mask")[0].alias("valid"))
        for k in ("history", "action")])
    out = out.select("episode", "frame", F.inline(items))
    return out.withColumn("value", r(F.col("value")))


@query(
    "udf03_canonicalise",
    "UDF-03 JN-12 FN-12 SRC-20 WIN-01 FN-10",
    f"""WITH {PF}, d AS (SELECT *, coalesce(lead(px) OVER w - px, px - lag(px) OVER w, 0) * 20 AS vx
      FROM pf WINDOW w AS (PARTITION BY episode ORDER BY frame))
    SELECT episode, frame, {R("CASE episode % 3 WHEN 0 THEN 0.5 * py WHEN 1 THEN least(greatest(vx, -2), 2) ELSE least(py, 2) END")} AS c0,
      {R("CASE episode % 3 WHEN 0 THEN grip WHEN 1 THEN least(grip, 1) ELSE 1 END")} AS c6 FROM d""",
)
def _(spark, sf):
    from epispark.operators.transforms import canonicalise, rule_arrays
    from epispark.sources.readers import registry_rules

    doc = (
        '{"version":"1","embodiments":{'
        '"arm0":{"kind":"ee_velocity_passthrough","native_dim":7,"scale":[0.5,1,1,1,1,1,1],"indices":'
        '{"linear_velocity_xyz":[0,1,2],"angular_velocity_xyz":[3,4,5],"gripper":6}},'
        '"arm1":{"kind":"ee_pose_finite_diff","native_dim":7,"fps":20,"indices":'
        '{"ee_position_xyz":[1,0,2],"ee_rotvec_xyz":[3,4,5],"gripper":6}},'
        '"arm2":{"kind":"joint_delta_to_ee_finite_diff","native_dim":7,"scale":[1,1,1,1,1,1,100],"indices":{}}}}'
    )
    text = table(spark, sf, "region").where("r_regionkey = 0").select(F.lit(doc).alias("doc"))
    rules = rule_arrays(registry_rules(text, "doc"))
    rows = pose_frames(spark, sf).select(
        "episode", "frame", F.concat(F.lit("arm"), F.col("episode") % 3).alias("embodiment"),
        F.array("py", "px", "pz", "pr", "pp", "pw", F.when(F.col("episode") % 3 == 2, 1.0).otherwise(F.col("grip"))).alias("a"))
    out = canonicalise(rows, rules, ["episode"], "frame", "a", "c")
    return out.select("episode", "frame", r(F.col("c")[0]).alias("c0"), r(F.col("c")[6]).alias("c6"))
