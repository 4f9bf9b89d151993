"""Window queries (WIN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.functions.ids import hash_uniform
from epispark.operators import windows as W
from epispark.plans.registry import R, query, r
from epispark.plans.views import EV, LF, PF, line_frames, pose_frames, signal_frames, table
from epispark.scale import Halo

PI = "pi()"


def wrap_sql(x: str) -> str:
    """Floored modulo, written out because the SQL remainder keeps the dividend's sign."""
    return f"(({x}) + {PI} - 2*{PI} * floor((({x}) + {PI}) / (2*{PI})) - {PI})"


@query(
    "win01_finite_difference",
    "WIN-01 WIN-02",
    f"""WITH {PF}, d AS (
      SELECT *, lead(px) OVER w - px AS ax, px - lag(px) OVER w AS bx,
        lead(pw) OVER w - pw AS aw, pw - lag(pw) OVER w AS bw
      FROM pf WINDOW w AS (PARTITION BY episode ORDER BY frame))
    SELECT episode, frame, {R("15.0 * coalesce(ax, bx, 0)")} AS v_px,
      {R("15.0 * coalesce(" + wrap_sql("aw") + ", " + wrap_sql("bw") + ", 0)")} AS v_pw, {R("grip")} AS grip
    FROM d""",
)
def _(spark, sf):
    out = W.finite_difference(
        pose_frames(spark, sf), ["episode"], "frame", ["px"], ["pw"], fps=15.0
    )
    return out.select(
        "episode", "frame", r(F.col("v_px")).alias("v_px"), r(F.col("v_pw")).alias("v_pw"),
        r(F.col("grip")).alias("grip"),
    )


@query(
    "win03_boundary_flag",
    "WIN-03",
    f"""WITH {EV}, t AS (
      SELECT *, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS txt FROM ev)
    SELECT episode, frame, txt,
      coalesce(txt <> lag(txt) OVER (PARTITION BY episode ORDER BY frame) AND txt <> '', false)
        AS boundary
    FROM t""",
)
def _(spark, sf):
    ev = signal_frames(spark, sf).withColumn(
        "txt", F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    )
    out = W.boundary_flag(ev, ["episode"], "frame", "txt", "boundary")
    return out.select("episode", "frame", "txt", "boundary")


OFFSETS = [-5, -1, 0, 3, 16]


def _offset_sql(padding: str) -> str:
    edge = {
        "first_last": "CASE WHEN f.frame + o.off < 0 THEN e.first_v ELSE e.last_v END",
        "zero": "0.0",
    }[padding]
    return f"""WITH {EV}, e AS (
      SELECT episode, count(*) AS n, arg_min(value, frame) AS first_v,
        arg_max(value, frame) AS last_v FROM ev GROUP BY episode),
    o AS (SELECT unnest({OFFSETS})::BIGINT AS off)
    SELECT f.episode, f.frame, o.off,
      {R(f"CASE WHEN f.frame + o.off BETWEEN 0 AND e.n - 1 THEN g.value ELSE {edge} END")} AS value,
      (f.frame + o.off BETWEEN 0 AND e.n - 1) AND f.event_type <> 'error' IS NOT NULL
        AND coalesce(g.event_type <> 'error', false) AS valid
    FROM ev f CROSS JOIN o JOIN e ON e.episode = f.episode
    LEFT JOIN ev g ON g.episode = f.episode AND g.frame = f.frame + o.off"""


def _offset_query(padding):
    def build(spark, sf):
        out = W.gather_offsets(
            signal_frames(spark, sf),
            ["episode"],
            "frame",
            {"vals": F.col("value")},
            OFFSETS,
            padding,
            mask=F.col("event_type") != "error",
        )
        offs = F.array(*[F.lit(o).cast("long") for o in OFFSETS])
        return out.select(
            "episode", "frame", F.inline(F.arrays_zip(offs.alias("off"), "vals", "mask"))
        ).select("episode", "frame", "off", r(F.col("vals")).alias("value"), F.col("mask").alias("valid"))

    return build


query("win04_offsets_first_last", "WIN-04 UDF-09", _offset_sql("first_last"))(
    _offset_query("first_last")
)
query("win04_offsets_zero", "WIN-04", _offset_sql("zero"))(_offset_query("zero"))


@query(
    "win05_clamped_offsets",
    "WIN-05",
    f"""WITH {EV}, n AS (SELECT episode, count(*) AS n FROM ev GROUP BY episode)
    SELECT ev.episode, ev.frame, o.d AS off,
      least(greatest(ev.frame + o.d, 0), n.n - 1) AS target
    FROM ev JOIN n USING (episode) CROSS JOIN (SELECT unnest([-5, 0, 5])::BIGINT AS d) o""",
)
def _(spark, sf):
    offs = [-5, 0, 5]
    ev = signal_frames(spark, sf)
    # the episode's last frame is within reach of the halo whenever an offset passes it
    halo = Halo(ev, ["episode"], "frame", after=max(offs))
    length = F.max("frame").over(halo.all) + 1
    rows = halo.close(halo.df.withColumn("length", length))
    pairs = F.arrays_zip(
        F.array(*[F.lit(o).cast("long") for o in offs]).alias("off"),
        W.clamp_offsets(F.col("frame"), offs, F.col("length")).alias("target"),
    )
    return rows.select("episode", "frame", F.inline(pairs))


@query(
    "win06_action_block",
    "WIN-06",
    f"""WITH {EV}, k AS (SELECT unnest(range(8)) AS i)
    SELECT f.episode, f.frame, k.i::INTEGER AS step, {R("coalesce(g.value, 0.0)")} AS value
    FROM ev f CROSS JOIN k
    LEFT JOIN ev g ON g.episode = f.episode AND g.frame = f.frame + k.i""",
)
def _(spark, sf):
    out = W.next_block(signal_frames(spark, sf), ["episode"], "frame", "value", 8, "block")
    out = out.select("episode", "frame", F.posexplode("block").alias("step", "value"))
    return out.withColumn("value", r(F.col("value")))


@query(
    "win07_sample_index",
    "WIN-07",
    f"""WITH {EV}, n AS (SELECT episode, count(*) AS n FROM ev GROUP BY episode),
    s AS (SELECT episode, n,
      unnest(range(18, greatest(19, n - 48), 6)) AS t FROM n),
    ok AS (SELECT episode, t FROM s WHERE t < n)
    SELECT * FROM ok
    UNION ALL SELECT episode, 0 FROM n WHERE NOT EXISTS (SELECT 1 FROM ok)""",
)
def _(spark, sf):
    n = table(spark, sf, "events").groupBy(F.col("user_id").alias("episode")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return W.sample_index(n, "episode", "n")


@query(
    "win07_sample_index_fallback",
    "WIN-07",
    """WITH n AS (SELECT l_orderkey AS episode, count(*) AS n FROM lineitem GROUP BY 1),
    s AS (SELECT episode, n, unnest(range(18, greatest(19, n - 48), 6)) AS t FROM n),
    ok AS (SELECT episode, t FROM s WHERE t < n)
    SELECT * FROM ok
    UNION ALL SELECT episode, 0 FROM n WHERE NOT EXISTS (SELECT 1 FROM ok)""",
)
def _(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return W.sample_index(n, "episode", "n")


@query(
    "win07_every_interval",
    "WIN-07",
    """WITH n AS (SELECT user_id AS episode, count(*) AS n FROM events GROUP BY 1)
    SELECT episode, unnest(range(0, n, 3)) AS t FROM n""",
)
def _(spark, sf):
    n = table(spark, sf, "events").groupBy(F.col("user_id").alias("episode")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return W.every_interval(n, "episode", "n", 3)


def mat_sql(p: str) -> dict[str, str]:
    """Entries of Rz(yaw) Ry(pitch) Rx(roll) with angle columns {p}pr, {p}pp, {p}pw."""
    c = {k: f"cos({p}{k})" for k in ("pr", "pp", "pw")}
    s = {k: f"sin({p}{k})" for k in ("pr", "pp", "pw")}
    return {
        "00": f"{c['pw']}*{c['pp']}",
        "10": f"{s['pw']}*{c['pp']}",
        "20": f"-{s['pp']}",
        "01": f"{c['pw']}*{s['pp']}*{s['pr']} - {s['pw']}*{c['pr']}",
        "11": f"{s['pw']}*{s['pp']}*{s['pr']} + {c['pw']}*{c['pr']}",
        "21": f"{c['pp']}*{s['pr']}",
        "02": f"{c['pw']}*{s['pp']}*{c['pr']} + {s['pw']}*{s['pr']}",
        "12": f"{s['pw']}*{s['pp']}*{c['pr']} - {c['pw']}*{s['pr']}",
        "22": f"{c['pp']}*{c['pr']}",
    }


def _delta_sql() -> str:
    cur = ", ".join(f"{e} AS c{k}" for k, e in mat_sql("").items())
    prev = ", ".join(f"lag({e}) OVER w AS p{k}" for k, e in mat_sql("").items())
    pos = ", ".join(f"{c} - lag({c}) OVER w AS d{c}" for c in ("px", "py", "pz"))

    def t(i):
        return f"p0{i}*dpx + p1{i}*dpy + p2{i}*dpz"

    def m(i, j):
        return f"(p0{i}*c0{j} + p1{i}*c1{j} + p2{i}*c2{j})"

    return f"""{PF}, m AS (SELECT episode, frame, {cur}, {prev}, {pos}
      FROM pf WINDOW w AS (PARTITION BY episode ORDER BY frame)),
    rel AS (SELECT episode, frame, {t(0)} AS tx, {t(1)} AS ty, {t(2)} AS tz,
      atan2({m(2,1)}, {m(2,2)}) AS rr, asin(greatest(least(-{m(2,0)}, 1), -1)) AS rp,
      atan2({m(1,0)}, {m(0,0)}) AS ry FROM m WHERE frame > 0)"""


POSE6 = ["px", "py", "pz", "pr", "pp", "pw"]


@query(
    "win08_pose_deltas",
    "WIN-08 FN-22 FN-23",
    f"""WITH {_delta_sql()}
    SELECT episode, frame, {R("tx")} AS d_px, {R("ty")} AS d_py, {R("tz")} AS d_pz,
      {R("rr")} AS d_pr, {R("rp")} AS d_pp, {R("ry")} AS d_pw FROM rel""",
)
def _(spark, sf):
    out = W.pose_deltas(pose_frames(spark, sf), ["episode"], "frame", POSE6)
    return out.select("episode", "frame", *[r(F.col("d_" + c)).alias("d_" + c) for c in POSE6])


@query(
    "win09_integrate_deltas",
    "WIN-09",
    f"""WITH {PF} SELECT episode, frame, {R("px", 5)} AS px, {R("py", 5)} AS py,
      {R("pz", 5)} AS pz, {R("cos(pr)", 5)} AS cr, {R("sin(pr)", 5)} AS sr, {R("pp", 5)} AS pp,
      {R("cos(pw)", 5)} AS cw, {R("sin(pw)", 5)} AS sw FROM pf""",
)
def _(spark, sf):
    poses = pose_frames(spark, sf)
    deltas = W.pose_deltas(poses, ["episode"], "frame", POSE6)
    first = poses.where("frame = 0").select("episode", *POSE6)
    out = W.integrate_deltas(
        deltas, first, "episode", "frame", ["d_" + c for c in POSE6], POSE6
    )
    c = F.col
    return out.select(
        "episode",
        "frame",
        *[r(c(n), 5).alias(n) for n in ("px", "py", "pz", "pp")],
        r(F.cos("pr"), 5).alias("cr"),
        r(F.sin("pr"), 5).alias("sr"),
        r(F.cos("pw"), 5).alias("cw"),
        r(F.sin("pw"), 5).alias("sw"),
    )


@query(
    "win10_trailing_mean_padded",
    "WIN-10",
    f"""WITH {EV}, s AS (SELECT *, sum(value) OVER w AS sm, count(*) OVER w AS n FROM ev
      WINDOW w AS (PARTITION BY episode ORDER BY frame ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))
    SELECT episode, frame, {R("(sm + (16 - n) * value) / 16")} AS m_value FROM s""",
)
def _(spark, sf):
    out = W.trailing_mean_padded(signal_frames(spark, sf), ["episode"], "frame", ["value"])
    return out.select("episode", "frame", r(F.col("m_value")).alias("m_value"))


@query(
    "win11_history_stack",
    "WIN-11",
    f"""WITH {EV}, o AS (SELECT unnest([-6, -4, -2, 0])::BIGINT AS off)
    SELECT f.episode, f.frame, o.off, g.event_id, {R("g.value")} AS value
    FROM ev f CROSS JOIN o
    JOIN ev g ON g.episode = f.episode AND g.frame = greatest(f.frame + o.off, 0)""",
)
def _(spark, sf):
    offs = [-6, -4, -2, 0]
    out = W.history_stack(
        signal_frames(spark, sf),
        ["episode"],
        "frame",
        {"h": F.struct("event_id", "value")},
        offs,
    )
    lits = F.array(*[F.lit(o).cast("long") for o in offs])
    out = out.select("episode", "frame", F.inline(F.arrays_zip(lits.alias("off"), "h")))
    return out.select(
        "episode", "frame", "off", "h.event_id", r(F.col("h.value")).alias("value")
    )


@query(
    "win12_ensemble_predictions",
    "WIN-12",
    f"""WITH {LF}, p AS (SELECT episode, frame AS t0, i, frame + i AS step,
        [x0 / 50 + i * x2, x2 * 10 - i * x3, x3 * 10 + i] AS v
      FROM lf CROSS JOIN (SELECT unnest(range(4)) AS i)),
    rf AS (SELECT episode, step, v AS ref FROM p WHERE i = 0),
    w AS (SELECT p.*, exp(2.0 * (list_dot_product(v, ref) /
        (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(ref, ref)) + 1e-7))) AS w
      FROM p JOIN rf USING (episode, step))
    SELECT episode, step, count(*)::INTEGER AS n_preds, {R("sum(w * v[1]) / sum(w)")} AS a0,
      {R("sum(w * v[2]) / sum(w)")} AS a1, {R("sum(w * v[3]) / sum(w)")} AS a2
    FROM w GROUP BY episode, step""",
)
def _(spark, sf):
    i = F.col("i")
    preds = line_frames(spark, sf).select(
        "episode", "frame", "x0", "x2", "x3", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")
    )
    preds = preds.select(
        "episode",
        F.col("frame").alias("t0"),
        "i",
        F.array(
            F.col("x0") / 50 + i * F.col("x2"),
            F.col("x2") * 10 - i * F.col("x3"),
            F.col("x3") * 10 + i,
        ).alias("v"),
    )
    out = W.ensemble_predictions(preds, ["episode"], "t0", "i", "v", horizon=4, alpha=2.0)
    return out.select(
        "episode", "step", "n_preds", *[r(F.col("action")[j]).alias(f"a{j}") for j in range(3)]
    )


@query(
    "win13_next_state",
    "WIN-13 PRJ-14",
    f"""WITH {EV}, o AS (SELECT unnest([-2, -1, 0, 1, 2])::BIGINT AS off),
    e AS (SELECT episode, count(*) AS n FROM ev GROUP BY 1),
    g AS (SELECT f.episode, f.frame, o.off, h.value AS v, f.event_type
      FROM ev f CROSS JOIN o JOIN e USING (episode)
      JOIN ev h ON h.episode = f.episode
        AND h.frame = least(greatest(f.frame + o.off, 0), e.n - 1))
    SELECT episode, frame,
      (CASE off WHEN -1 THEN 0 WHEN 1 THEN 1 ELSE 2 END)::INTEGER AS pos,
      {R("CASE WHEN event_type = 'view' THEN 1 - v ELSE v END")} AS value
    FROM g WHERE off NOT IN (-2, 0)""",
)
def _(spark, sf):
    # history = offsets -2, -1; prediction = 0, 1, 2; the first entry of each part is dropped
    out = W.gather_offsets(
        signal_frames(spark, sf), ["episode"], "frame", {"v": F.col("value")}, [-2, -1, 0, 1, 2]
    )
    part = W.delta_parts(F.col("v"), 2, F.col("event_type") == "view")
    out = out.select("episode", "frame", F.posexplode(part).alias("pos", "value"))
    return out.withColumn("value", r(F.col("value")))


U13 = "('0x' || substr(md5({0}), 1, 13))::BIGINT / 4503599627370496.0"


def u_sql(*parts: str) -> str:
    """SQL twin of ``hash_uniform``."""
    text = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return "(" + U13.format(text) + ")"


@query(
    "win14_stale_snapshot",
    "WIN-14",
    f"""WITH {EV}, s AS (SELECT episode, frame AS rf FROM ev WHERE event_id % 97 = 0),
    c AS (SELECT f.episode, f.frame, s.rf,
        row_number() OVER (PARTITION BY f.episode, f.frame ORDER BY s.rf DESC) AS rn
      FROM ev f JOIN s ON s.episode = f.episode AND s.rf BETWEEN f.frame - 60 AND f.frame),
    l AS (SELECT episode, frame, list(rf ORDER BY rf) AS a FROM c WHERE rn <= 8 GROUP BY 1, 2),
    live AS (SELECT episode, frame, max(CASE WHEN event_id % 97 = 0 THEN frame END)
        OVER (PARTITION BY episode ORDER BY frame) AS rf FROM ev)
    SELECT live.episode, live.frame,
      CASE WHEN {u_sql("7", "live.episode", "live.frame", "'coin'")} < 0.5 AND len(a) > 0
        THEN a[1 + floor({u_sql("7", "live.episode", "live.frame", "'pick'")} * len(a))::BIGINT]
        ELSE live.rf END AS snapshot
    FROM live LEFT JOIN l USING (episode, frame)""",
)
def _(spark, sf):
    # refreshes are rare, so that gaps are longer than the look-back of stale snapshots
    out = W.pick_stale_snapshot(
        signal_frames(spark, sf), ["episode"], "frame", F.col("event_id") % 97 == 0, seed=7
    )
    return out.select("episode", "frame", "snapshot")


@query(
    "win15_moving_average",
    "WIN-15",
    f"""WITH {EV} SELECT episode, frame, {R('''avg(value) OVER (PARTITION BY episode ORDER BY frame
      ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)''')} AS ma FROM ev""",
)
def _(spark, sf):
    out = W.moving_average(signal_frames(spark, sf), ["episode"], "frame", "value", 10, "ma")
    return out.select("episode", "frame", r(F.col("ma")).alias("ma"))


@query(
    "win16_dense_manifest_index",
    "WIN-16 SRT-01",
    """SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS episode_idx
    FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    out = W.global_index(docs, ["source", "doc_id"], "episode_idx")
    return out.select("doc_id", "episode_idx")


@query(
    "win17_start_offsets",
    "WIN-17",
    """WITH n AS (SELECT l_orderkey AS episode, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT episode, n, coalesce(sum(n) OVER (ORDER BY episode
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM n""",
)
def _(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return W.start_offsets(n, "episode", "n", "start")


@query(
    "win18_retained_checkpoints",
    "WIN-18",
    """WITH k AS (SELECT o_custkey AS run, o_orderkey AS step, o_totalprice AS score,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS best
      FROM orders)
    SELECT run, step, score, best = 1 AS is_best FROM k WHERE rn <= 3 OR best = 1""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"),
        F.col("o_orderkey").alias("step"),
        F.col("o_totalprice").alias("score"),
    )
    return W.retained_checkpoints(o, "run", "step", "score", keep=3)


@query(
    "win19_hold_last_frame",
    "WIN-19 PRJ-13",
    f"""WITH {EV}, n AS (SELECT episode, count(*) AS n, arg_max(value, frame) AS v, arg_min(event_type, frame) AS s
      FROM ev GROUP BY 1)
    SELECT episode, frame AS pos, {R("value")} AS value, event_type AS txt FROM ev
    UNION ALL SELECT episode, unnest(range(n, (n + 63) // 64 * 64)), {R("v")}, s FROM n""",
)
def _(spark, sf):
    out = W.pad_episodes(signal_frames(spark, sf), ["episode"], "frame", 64, last=["value"], first=["event_type"])
    return out.select("episode", F.col("frame").alias("pos"), r(F.col("value")).alias("value"),
                      F.col("event_type").alias("txt"))


@query(
    "win20_future_trajectory",
    "WIN-20",
    f"""WITH {LF}, z AS (SELECT episode, frame, x0 AS p,
        CASE WHEN x2 > 0.05 THEN x2 ELSE 0 END AS ra, CASE WHEN x2 > 0.05 THEN x3 ELSE 0 END AS rb
      FROM lf)
    SELECT f.episode, f.frame, (g.frame - f.frame)::INTEGER AS h, {R("g.p")} AS p,
      {R('''coalesce((SELECT arg_max(q.ra, q.frame) FROM z q WHERE q.episode = f.episode
        AND q.frame > f.frame AND q.frame <= g.frame AND (q.ra <> 0 OR q.rb <> 0)), f.ra)''')} AS ra
    FROM z f JOIN z g ON g.episode = f.episode AND g.frame BETWEEN f.frame AND f.frame + 5""",
)
def _(spark, sf):
    z = line_frames(spark, sf).select(
        "episode",
        "frame",
        F.col("x0").alias("p"),
        F.when(F.col("x2") > 0.05, F.col("x2")).otherwise(F.lit(0.0)).alias("ra"),
        F.when(F.col("x2") > 0.05, F.col("x3")).otherwise(F.lit(0.0)).alias("rb"),
    )
    out = W.future_trajectory(z, ["episode"], "frame", ["p"], ["ra", "rb"], horizon=5)
    out = out.select("episode", "frame", F.inline("path"))
    return out.select(
        "episode", "frame", "h", r(F.col("p")).alias("p"), r(F.col("rot.ra")).alias("ra")
    )
