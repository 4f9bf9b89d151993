"""Join, projection, filter, set and ordering queries (JN-*, PRJ-*, FLT-*, SET-*, SRT-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.functions import text as X
from epispark.functions import vectors as V
from epispark.functions.ids import hash_uniform
from epispark.operators import joins as J
from epispark.operators import quality as Q
from epispark.operators import windows as W
from epispark.plans.q_windows import u_sql
from epispark.plans.registry import R, query, r
from epispark.plans.views import EV, LF, line_frames, signal_frames, table
from epispark.scale import dense_index


def orders(spark, sf):
    return table(spark, sf, "orders")


# ---- joins --------------------------------------------------------------------------------


@query(
    "jn01_resolve_instruction",
    "JN-01",
    """WITH c AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '' ELSE text END AS t FROM benchmark)
    SELECT d.doc_id, md5(coalesce(nullif(c.t, ''), d.text)) AS digest
    FROM documents d LEFT JOIN c ON c.item_id = d.doc_id""",
)
def _(spark, sf):
    clean = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"),
        F.when(F.col("item_id") % 3 == 0, "").otherwise(F.col("text")).alias("text"),
    )
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("raw"))
    out = J.resolve_instruction(docs, clean, "doc_id", "raw", "instruction")
    return out.select("doc_id", F.md5(F.col("instruction").cast("binary")).alias("digest"))


@query(
    "jn02_task_text",
    "JN-02 SRC-07",
    f"""WITH {LF}, n AS (SELECT episode, count(*) AS n FROM lf GROUP BY 1),
    o AS (SELECT unnest([0, 3])::BIGINT AS off)
    SELECT f.episode, f.frame, o.off, p.p_name AS task FROM lf f JOIN n USING (episode) CROSS JOIN o
    JOIN lf g ON g.episode = f.episode AND g.frame = least(f.frame + o.off, n.n - 1)
    JOIN part p ON p.p_partkey = g.pk""",
)
def _(spark, sf):
    rows = W.gather_offsets(
        line_frames(spark, sf), ["episode"], "frame", {"ids": F.col("pk")}, [0, 3]
    )
    offs = F.array(F.lit(0).cast("long"), F.lit(3).cast("long"))
    rows = rows.select("episode", "frame", F.inline(F.arrays_zip(offs.alias("off"), "ids")))
    tasks = table(spark, sf, "part").select(
        F.col("p_partkey").alias("task_index"), F.col("p_name").alias("task")
    )
    return J.attach_task(rows, tasks, "ids").select("episode", "frame", "off", "task")


SEG_SQL = f"""WITH {EV}, n AS (SELECT episode, count(*) AS t FROM ev GROUP BY 1),
  s AS (SELECT episode, unnest([0, 1, 2]) AS seg FROM n),
  sg AS (SELECT s.episode, seg, (ARRAY[-3, 5, 10])[seg + 1] + s.episode % 4 AS st,
      (ARRAY[12, 30, 200])[seg + 1] AS en,
      CASE seg WHEN 1 THEN 'goal' || (s.episode % 3) END AS l1,
      CASE seg WHEN 0 THEN 'approach' WHEN 1 THEN 'grasp' END AS l2,
      CASE seg WHEN 2 THEN 'close' ELSE 'x+' END AS l3 FROM s)"""


@query(
    "jn03_promote_segments",
    "JN-03 UDF-11 FN-32",
    f"""{SEG_SQL}, c AS (SELECT f.episode, f.frame,
        arg_max(l1, seg) FILTER (l1 IS NOT NULL) AS l1, arg_max(l2, seg) FILTER (l2 IS NOT NULL) AS l2,
        arg_max(l3, seg) FILTER (l3 IS NOT NULL) AS l3
      FROM ev f JOIN sg ON sg.episode = f.episode AND f.frame >= greatest(st, 0) AND f.frame < en
      GROUP BY 1, 2)
    SELECT f.episode, f.frame, coalesce(l1, 'task' || f.episode) AS level_1,
      coalesce(l2, '') AS level_2, coalesce(l3, '') AS level_3
    FROM ev f LEFT JOIN c USING (episode, frame)""",
)
def _(spark, sf):
    ev = signal_frames(spark, sf).select("episode", "frame")
    users = table(spark, sf, "events").select(F.col("user_id").alias("episode")).distinct()
    # segments arrive as JSON text; a segment may start before frame 0 or end past the episode
    shift = F.col("episode") % 4
    seg = F.format_string(
        '[{"start":%d,"end":12,"level_2":"approach","level_3":"x+"},'
        '{"start":%d,"end":30,"level_1":"goal%d","level_2":"grasp","level_3":"x+"},'
        '{"start":%d,"end":200,"level_3":"close"}]',
        shift - 3, shift + 5, F.col("episode") % 3, shift + 10,
    )
    heads = users.select(
        "episode",
        F.concat(F.lit("task"), F.col("episode")).alias("task"),
        X.parse_segments(seg).alias("segments"),
    )
    out = J.promote_segments(ev, heads, "episode", "frame", "task", "segments")
    return out.select("episode", "frame", "level_1", "level_2", "level_3")


@query(
    "jn04_asof_nearest",
    "JN-04",
    f"""WITH {EV}, v AS (SELECT episode, us, event_id, value FROM ev WHERE event_type = 'view'),
    m AS (SELECT p.event_id, v.event_id AS hit, row_number() OVER (PARTITION BY p.event_id
        ORDER BY abs(v.us - p.us), v.us, v.event_id) AS rn
      FROM ev p JOIN v USING (episode) WHERE p.event_type = 'purchase')
    SELECT p.event_id, m.hit FROM ev p LEFT JOIN m ON m.event_id = p.event_id AND rn = 1
    WHERE p.event_type = 'purchase'""",
)
def _(spark, sf):
    ev = raw_events(spark, sf)
    out = J.asof_nearest(
        ev.where("event_type = 'purchase'"), ev.where("event_type = 'view'"), ["episode"], "us",
        "event_id", ["value"],
    )
    return out.select("event_id", F.col("match.event_id").alias("hit"))


def raw_events(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("episode"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "event_type",
        "value",
    )


@query(
    "jn05_asof_backward",
    "JN-05",
    f"""WITH {EV} SELECT p.event_id, v.event_id AS hit, {R("v.value")} AS value
    FROM (SELECT * FROM ev WHERE event_type = 'purchase') p
    ASOF LEFT JOIN (SELECT * FROM ev WHERE event_type = 'view') v
      ON p.episode = v.episode AND p.us >= v.us""",
)
def _(spark, sf):
    ev = raw_events(spark, sf)
    out = J.asof_backward(
        ev.where("event_type = 'purchase'"), ev.where("event_type = 'view'"), ["episode"], "us",
        "event_id", ["value"],
    )
    return out.select("event_id", F.col("match.event_id").alias("hit"),
                      r(F.col("match.value")).alias("value"))


@query(
    "jn06_feature_window",
    "JN-06",
    f"""WITH {EV}, ft AS (SELECT episode, frame // 6 AS i, value FROM ev WHERE frame % 6 = 0),
    n AS (SELECT episode, max(i) + 1 AS n FROM ft GROUP BY 1),
    s AS (SELECT episode, frame AS t FROM ev)
    SELECT s.episode, s.t, p.pos::INTEGER AS pos, ft.i AS feat_idx, {R("ft.value")} AS value
    FROM s JOIN n USING (episode) CROSS JOIN (SELECT unnest(range(12)) AS pos) p
    JOIN ft ON ft.episode = s.episode
      AND ft.i = greatest(0, least(floor((s.t + (p.pos - 3) * 6) / 6.0)::BIGINT, n.n - 1))""",
)
def _(spark, sf):
    ev = signal_frames(spark, sf)
    feats = Q.subsample_rate(ev, "frame", F.lit(30.0), F.lit(5.0)).select(
        "episode", F.floor(F.col("frame") / 6).alias("feat_idx"), "value"
    )
    samples = ev.select("episode", F.col("frame").alias("t"))
    out = J.feature_window(samples, feats, ["episode"], "t", "feat_idx", 6, 4, 8, "value")
    return out.select("episode", "t", "pos", "feat_idx", r(F.col("value")).alias("value"))


@query(
    "jn07_skip_done",
    "JN-07 SNK-04",
    """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
      OR o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1
        HAVING arg_max(l_linestatus, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) <> 'F')""",
)
def _(spark, sf):
    last = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    ledger = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max_by("l_linestatus", last).alias("s")
    )
    ledger = ledger.select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.when(F.col("s") == "F", "done").otherwise("failed").alias("status"),
    )
    return J.not_done(orders(spark, sf).select("o_orderkey"), ledger, ["o_orderkey"])


@query(
    "jn08_changed_chunks",
    "JN-08 SNK-10 UDF-10",
    """WITH cur AS (SELECT o_orderkey // 500 AS chunk, sum(o_totalprice::DECIMAL(18,2))::VARCHAR AS h FROM orders GROUP BY 1),
    old AS (SELECT o_orderkey // 500 AS chunk, sum(o_totalprice::DECIMAL(18,2))::VARCHAR AS h FROM orders
      WHERE o_orderkey % 1501 <> 7 GROUP BY 1)
    SELECT chunk FROM cur WHERE (chunk, h) NOT IN (SELECT chunk, h FROM old)""",
)
def _(spark, sf):
    def state(df):
        total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string")
        return df.groupBy(F.floor(F.col("o_orderkey") / 500).alias("chunk")).agg(total.alias("h"))

    o = orders(spark, sf)
    return J.changed(state(o), state(o.where("o_orderkey % 1501 <> 7")), ["chunk"], "h").select("chunk")


LEDGER_SQL = """g AS (SELECT o_custkey AS chunk, (ascii(o_orderpriority) - 49)::BIGINT AS stage,
    CASE arg_max(o_orderstatus, o_orderkey) WHEN 'F' THEN 'done' WHEN 'O' THEN 'done'
      ELSE CASE WHEN max(o_orderkey) % 2 = 0 THEN 'pending' ELSE 'requeued' END END AS status
  FROM orders GROUP BY 1, 2)"""


def stage_ledger(spark, sf):
    o = orders(spark, sf)
    return o.groupBy(
        F.col("o_custkey").alias("chunk"),
        (F.ascii("o_orderpriority") - 49).cast("long").alias("stage"),
    ).agg(
        F.when(F.max_by("o_orderstatus", "o_orderkey").isin("F", "O"), "done")
        .when(F.max("o_orderkey") % 2 == 0, "pending")
        .otherwise("requeued")
        .alias("status")
    )


@query(
    "jn09_ready_work",
    "JN-09",
    f"""WITH {LEDGER_SQL} SELECT chunk, stage, status FROM g WHERE status IN ('pending', 'requeued')
      AND (SELECT count(*) FROM g p WHERE p.chunk = g.chunk AND p.stage < g.stage
        AND p.status = 'done') = g.stage""",
)
def _(spark, sf):
    return J.ready_work(stage_ledger(spark, sf), ["chunk"], "stage", "status")


@query(
    "jn10_missing_artefacts",
    "JN-10",
    """WITH w AS (SELECT o_orderkey, unnest(['A', 'N', 'R']) AS artefact FROM orders)
    SELECT o_orderkey, artefact FROM w WHERE NOT EXISTS (SELECT 1 FROM lineitem l
      WHERE l.l_orderkey = w.o_orderkey AND l.l_returnflag = w.artefact)""",
)
def _(spark, sf):
    files = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("artefact")
    )
    return J.missing_artefacts(
        orders(spark, sf).select("o_orderkey"), files, "o_orderkey", "artefact", ["A", "N", "R"]
    )


@query(
    "jn10_completeness",
    "JN-10 AGG-08",
    """WITH f AS (SELECT l_orderkey AS k, count(DISTINCT l_returnflag) AS have,
        bool_or(l_linestatus = 'O') AS cam FROM lineitem GROUP BY 1)
    SELECT o_orderkey % 16 AS chunk, count(*) AS n_episodes,
      sum(3 - coalesce(have, 0))::BIGINT AS n_missing, count_if(NOT coalesce(cam, false))::BIGINT AS n_no_camera,
      sum(3 - coalesce(have, 0)) = 0 AND count_if(NOT coalesce(cam, false)) = 0 AS ok
    FROM orders LEFT JOIN f ON k = o_orderkey GROUP BY 1""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    names = F.array(
        "l_returnflag", F.when(F.col("l_linestatus") == "O", F.lit("camera_head")).otherwise("x")
    )
    files = li.select(F.col("l_orderkey").alias("o_orderkey"), F.explode(names).alias("name"))
    ep = orders(spark, sf).select("o_orderkey", (F.col("o_orderkey") % 16).alias("chunk"))
    return J.completeness(ep, files, "o_orderkey", "name", "chunk", ["A", "N", "R"])


@query(
    "jn12_attach_rule",
    "JN-12 SRC-20 FN-12 UDF-03",
    f"""WITH {LF} SELECT episode, frame, {R("CASE sk % 3 WHEN 0 THEN x3 WHEN 1 THEN x0 * 0.5 ELSE x2 END")}
      AS c0 FROM lf""",
)
def _(spark, sf):
    from epispark.sources.readers import registry_rules

    # registry text derived from the suppliers: one embodiment per supplier class
    doc = table(spark, sf, "supplier").select(
        F.concat(
            F.lit('{"version":"1","embodiments":{'),
            F.format_string(
                '"arm%d":{"kind":"%s","native_dim":%d,"scale":[%s,1,1,1,1,1,1]}}}',
                F.col("s_suppkey") % 3,
                F.element_at(
                    F.array(F.lit("last"), F.lit("first"), F.lit("middle")),
                    (F.col("s_suppkey") % 3 + 1).cast("int"),
                ),
                F.lit(4),
                F.when(F.col("s_suppkey") % 3 == 1, "0.5").otherwise("1.0"),
            ),
        ).alias("doc")
    ).distinct()
    rules = registry_rules(doc, "doc").select("embodiment", "kind", "native_dim", "scale")
    rows = line_frames(spark, sf).select(
        "episode", "frame", "x0", "x2", "x3",
        F.concat(F.lit("arm"), F.col("sk") % 3).alias("embodiment"),
    )
    out = J.attach_rule(rows, rules)
    picked = (
        F.when(F.col("kind") == "last", F.col("x3"))
        .when(F.col("kind") == "first", F.col("x0"))
        .otherwise(F.col("x2"))
    )
    return out.where(F.col("embodiment") != "").select(
        "episode", "frame", r(picked * F.col("scale")[0]).alias("c0")
    )


@query(
    "jn12_quarantine",
    "JN-12 FLT-13",
    """WITH r AS (SELECT s_suppkey, s_suppkey % 7 AS dims FROM supplier WHERE s_suppkey % 5 <> 0)
    SELECT l_suppkey, CASE WHEN dims IS NULL THEN 'unknown embodiment' ELSE 'too few dims' END AS reason,
      count(*) AS n FROM lineitem LEFT JOIN r ON s_suppkey = l_suppkey
    WHERE dims IS NULL OR dims > 4 GROUP BY 1, 2""",
)
def _(spark, sf):
    rules = table(spark, sf, "supplier").where("s_suppkey % 5 <> 0").select(
        F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") % 7).alias("native_dim")
    )
    li = table(spark, sf, "lineitem").select("l_suppkey")
    _, bad = J.split_by_rule(li, rules, "l_suppkey", F.lit(4))
    return bad.groupBy("l_suppkey", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jn13_task_dataset_bridge",
    "JN-13",
    """SELECT DISTINCT r_name AS task, s_suppkey AS dataset FROM region
      JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey""",
)
def _(spark, sf):
    tasks = table(spark, sf, "region").join(
        table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("r_name").alias("task"), F.col("n_nationkey").alias("tag"))
    sets = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("dataset"), F.col("s_nationkey").alias("tag"))
    return J.bridge(tasks, sets, "tag").select("task", "dataset").distinct()


@query(
    "jn14_start_offsets",
    "JN-14 SRC-06",
    f"""WITH {LF} SELECT episode, frame, {R("frame / 15.0 + (o_custkey % 100) / 4.0")} AS timestamp
    FROM lf JOIN orders ON o_orderkey = episode""",
)
def _(spark, sf):
    from epispark.sources.readers import shift_timestamps

    frames = line_frames(spark, sf).select(
        F.col("episode").alias("episode_index"), "frame", (F.col("frame") / 15.0).alias("timestamp"))
    ep = orders(spark, sf).select(
        F.col("o_orderkey").alias("episode_index"),
        ((F.col("o_custkey") % 100) / 4.0).alias("from_timestamp"))
    out = shift_timestamps(frames, ep)
    return out.select(F.col("episode_index").alias("episode"), "frame", r(F.col("timestamp")).alias("timestamp"))


@query(
    "jn15_camera_tokens",
    "JN-15",
    f"""WITH e AS (SELECT vec_id // 4 AS idx, vec_id % 4 AS cam, embedding FROM embeddings),
    t AS (SELECT idx, unnest(list_concat(embedding[1:2], embedding[3:4])) AS x, unnest(range(4)) AS p,
        (ARRAY[2, 0, 1, NULL])[cam + 1] AS ord FROM e)
    SELECT idx, (row_number() OVER (PARTITION BY idx ORDER BY ord, p) - 1)::INTEGER AS pos,
      {R("x::DOUBLE")} AS x FROM t WHERE ord IS NOT NULL""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(
        F.floor(F.col("vec_id") / 4).alias("idx"), (F.col("vec_id") % 4).alias("cam"),
        F.array(F.slice("embedding", 1, 2), F.slice("embedding", 3, 2)).alias("tokens"))
    cams = table(spark, sf, "embeddings").select((F.col("vec_id") % 4).alias("cam")).distinct()
    cams = cams.select("cam", F.get(F.array(F.lit(2), F.lit(0), F.lit(1)), F.col("cam").cast("int")).alias("cam_order"))
    out = J.concat_camera_tokens(e, cams.where("cam_order is not null"), ["idx"], "cam", "tokens")
    out = out.select("idx", F.posexplode(F.flatten("tokens")).alias("pos", "x"))
    return out.select("idx", "pos", r(F.col("x").cast("double")).alias("x"))


@query(
    "jn17_unique_position",
    "JN-17",
    """SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) AS position FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
)
def _(spark, sf):
    has = orders(spark, sf).select(F.col("o_custkey").alias("c_custkey"))
    cust = table(spark, sf, "customer").select("c_custkey").join(has, "c_custkey", "left_semi")
    pos = W.global_index(cust, ["c_custkey"], "position")
    return J.unique_position(pos, ["c_custkey"], "position")


@query(
    "jn17_duplicate_keys",
    "JN-17",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(spark, sf):
    return J.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---- projections --------------------------------------------------------------------------


@query(
    "prj05_pad_with_mask",
    "PRJ-05 FN-38",
    f"""WITH {LF} SELECT episode, frame, i::INTEGER AS i,
      {R("CASE WHEN i < 4 THEN [x0, x1, x2, x3][i + 1] ELSE 0 END")} AS value, i < 4 AS mask,
      {R("CASE WHEN i < 3 THEN [x0, x1, x2][i + 1] END")} AS fitted
    FROM lf CROSS JOIN (SELECT unnest(range(6)) AS i)""",
)
def _(spark, sf):
    v = F.array("x0", "x1", "x2", "x3")
    x, m = V.pad_with_mask(v, F.array(*[F.lit(True)] * 4), 6)
    z = F.arrays_zip(x.alias("x"), m.alias("m"), V.fit(v, 3).alias("f"))
    out = line_frames(spark, sf).select("episode", "frame", F.posexplode(z).alias("i", "z"))
    return out.select("episode", "frame", "i", r(F.col("z.x")).alias("value"),
                      F.col("z.m").alias("mask"), r(F.col("z.f")).alias("fitted"))


@query(
    "prj06_pad_for_key",
    "PRJ-06",
    f"""WITH {LF}, k AS (SELECT unnest(['left_eef_position', 'right_arm', 'left_hand', 'gripper_width']) AS key,
        unnest([3, 7, 6, 6]) AS w),
    z AS (SELECT *, CASE WHEN x2 > 0.05 THEN [x2, x3, x0 / 50, x2 + x3] ELSE [0.0, 0, 0, 0] END AS v FROM lf)
    SELECT episode, frame, key, w::INTEGER AS width,
      {R("CASE WHEN key LIKE '%right%' THEN 0 ELSE list_sum(v[1:least(w, 4)]) END")} AS total,
      (CASE WHEN key LIKE '%right%' OR x2 <= 0.05 THEN 0 ELSE least(w, 4) END)::INTEGER AS n_true
    FROM z CROSS JOIN k""",
)
def _(spark, sf):
    zero = [F.lit(0.0)] * 4
    live = [F.col("x2"), F.col("x3"), F.col("x0") / 50, F.col("x2") + F.col("x3")]
    rows = line_frames(spark, sf).withColumn(
        "v", F.when(F.col("x2") > 0.05, F.array(*live)).otherwise(F.array(*zero)))
    items = []
    for key in ("left_eef_position", "right_arm", "left_hand", "gripper_width"):
        x, m = V.pad_for_key(F.col("v"), key, single_arm=True)
        items.append(F.struct(F.lit(key).alias("key"), x.alias("x"), m.alias("m")))
    out = rows.select("episode", "frame", F.inline(F.array(*items)))
    return out.select(
        "episode", "frame", "key", F.size("x").alias("width"),
        r(F.aggregate("x", F.lit(0.0), lambda s, x: s + x)).alias("total"),
        F.size(F.filter("m", lambda b: b)).alias("n_true"))


@query(
    "prj07_logical_slice",
    "PRJ-07 SRC-08",
    f"""WITH {LF}, m AS (SELECT unnest(['arm', 'gripper', 'tail']) AS key, unnest([0, 2, 1]) AS s, unnest([2, 3, 4]) AS e)
    SELECT episode, frame, key, (e - s)::INTEGER AS width, {R("list_sum(([x0, x1, x2, x3])[s + 1:e])")} AS total
    FROM lf CROSS JOIN m""",
)
def _(spark, sf):
    v = F.array("x0", "x1", "x2", "x3")
    spans = {"arm": (0, 2), "gripper": (2, 3), "tail": (1, 4)}
    items = [F.struct(F.lit(k).alias("key"), V.logical_slice(v, a, b).alias("x")) for k, (a, b) in spans.items()]
    out = line_frames(spark, sf).select("episode", "frame", F.inline(F.array(*items)))
    total = F.aggregate("x", F.lit(0.0), lambda s, x: s + x)
    return out.select("episode", "frame", "key", F.size("x").alias("width"), r(total).alias("total"))


@query(
    "prj08_concat_split",
    "PRJ-08 PRJ-17",
    f"""WITH {LF} SELECT episode, frame, {R("x2")} AS a0, {R("x3")} AS a1, {R("x0")} AS b0,
      4::INTEGER AS width FROM lf""",
)
def _(spark, sf):
    both = F.concat(F.array("x2", "x3"), F.array("x0", "x1"))
    rows = line_frames(spark, sf).withColumn("v", both)
    parts = V.split(F.col("v"), {"a": 2, "b": 2})
    return rows.select(
        "episode", "frame", r(parts["a"][0]).alias("a0"), r(parts["a"][1]).alias("a1"),
        r(parts["b"][0]).alias("b0"), F.size("v").alias("width"))


@query(
    "prj09_slice_statistics",
    "PRJ-09 SRC-09",
    f"""WITH s AS (SELECT p_brand AS column_, p_size::INTEGER AS dim, avg(p_retailprice) AS mean FROM part GROUP BY 1, 2)
    SELECT column_ || '.key' AS key, (dim - 10)::INTEGER AS dim, {R("mean", 4)} AS mean FROM s
    WHERE dim >= 10 AND dim < 30""",
)
def _(spark, sf):
    from epispark.operators.stats import slice_statistics

    p = table(spark, sf, "part")
    s = p.groupBy(F.col("p_brand").alias("column"), F.col("p_size").cast("int").alias("dim")).agg(
        F.avg("p_retailprice").alias("mean"))
    m = p.select(F.col("p_brand").alias("column")).distinct().select(
        "column", F.concat("column", F.lit(".key")).alias("key"), F.lit(10).alias("start"), F.lit(30).alias("end"))
    return slice_statistics(s, m).select("key", "dim", r(F.col("mean"), 4).alias("mean"))


@query(
    "prj10_rename_cameras",
    "PRJ-10",
    """SELECT page_id, CASE regexp_extract(url, '/([a-z]{2})/', 1) WHEN 'en' THEN 'head_rgb'
      WHEN 'de' THEN 'head_rgb' WHEN 'fr' THEN 'wrist_rgb' END AS camera FROM pages
    WHERE regexp_extract(url, '/([a-z]{2})/', 1) IN ('en', 'de', 'fr')""",
)
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("camera"))
    canon = F.when(F.col("camera").isin("en", "de"), "head_rgb").when(F.col("camera") == "fr", "wrist_rgb")
    aliases = p.select("camera").distinct().select(F.col("camera").alias("alias"), canon.alias("canonical"))
    return J.rename_cameras(p, aliases.where("canonical is not null"), "camera").select("page_id", "camera")


@query(
    "prj11_default_timestamps",
    "PRJ-11 PRJ-12",
    f"""WITH {LF} SELECT episode, frame, {R("CASE WHEN pk % 3 = 0 THEN pk / 4.0 ELSE frame / 15.0 END")} AS timestamp,
      {R("CASE WHEN pk % 5 = 0 THEN 0 ELSE x2 END")} AS gripper, '' AS level_2 FROM lf""",
)
def _(spark, sf):
    from epispark.sources.readers import with_default_columns

    rows = line_frames(spark, sf).select(
        "episode", "frame", F.when(F.col("pk") % 3 == 0, F.col("pk") / 4.0).alias("timestamp"),
        F.when(F.col("pk") % 5 != 0, F.col("x2")).alias("gripper"))
    out = with_default_columns(rows, {
        "timestamp": F.col("frame") / F.lit(15.0), "gripper": F.lit(0.0), "level_2": F.lit("")})
    return out.select("episode", "frame", r(F.col("timestamp")).alias("timestamp"),
                      r(F.col("gripper")).alias("gripper"), "level_2")


@query(
    "prj15_zero_block",
    "PRJ-15",
    f"""WITH {LF} SELECT episode, frame, 67::INTEGER AS width, {R("x2")} AS at_0, 0.0::DOUBLE AS at_33,
      {R("x3")} AS at_66 FROM lf""",
)
def _(spark, sf):
    v = V.insert_zero_block(F.array("x2", "x0"), F.array("x0", "x3"), 63)
    rows = line_frames(spark, sf).withColumn("v", v)
    return rows.select("episode", "frame", F.size("v").alias("width"), r(F.col("v")[0]).alias("at_0"),
                       r(F.col("v")[33]).alias("at_33"), r(F.col("v")[66]).alias("at_66"))


@query(
    "prj16_visibility_mask",
    "PRJ-16",
    f"""WITH {LF} SELECT episode, frame, i::INTEGER AS i, (i < 2) AND sk % 2 = 0 AS mask
    FROM lf CROSS JOIN (SELECT unnest(range(3)) AS i)""",
)
def _(spark, sf):
    m = V.mask_and(F.array(F.lit(True), F.lit(True), F.lit(False)), F.col("sk") % 2 == 0)
    return line_frames(spark, sf).select("episode", "frame", F.posexplode(m).alias("i", "mask"))


@query(
    "prj18_explode_stack_round_trip",
    "PRJ-18 PRJ-19",
    f"""WITH {EV} SELECT episode, frame // 32 AS block, (frame % 32)::INTEGER AS pos, {R("value")} AS value, event_type
    FROM ev""",
)
def _(spark, sf):
    blocks = Q.stack_blocks(signal_frames(spark, sf), ["episode"], "frame", ["value", "event_type"], 32)
    out = Q.explode_arrays(blocks, ["episode", "block"], "pos", ["value", "event_type"])
    return out.withColumn("value", r(F.col("value")))


# ---- filters ------------------------------------------------------------------------------


@query("flt01_drop_simulated", "FLT-01", "SELECT doc_id FROM documents WHERE source NOT IN ('src3', 'src7')")
def _(spark, sf):
    return Q.drop_simulated(table(spark, sf, "documents"), "source", ["src3", "src7"]).select("doc_id")


@query(
    "flt02_long_enough",
    "FLT-02",
    """SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 70)""",
)
def _(spark, sf):
    kept = Q.long_enough(table(spark, sf, "events"), "user_id", 70)
    return Q.require_rows(kept, "episodes").select("event_id")


@query(
    "flt03_language_at_start",
    "FLT-03",
    f"""WITH {LF} SELECT episode FROM lf JOIN part ON p_partkey = pk WHERE frame = 0 AND p_size > 10""",
)
def _(spark, sf):
    tasks = table(spark, sf, "part").select(
        F.col("p_partkey").alias("task_index"),
        F.when(F.col("p_size") > 10, F.col("p_name")).otherwise("").alias("task"))
    first = line_frames(spark, sf).where("frame = 0").select("episode", F.col("pk").alias("task_index"))
    return Q.with_language(first, tasks, "episode")


for _mode, _cond in (("contiguous", "o_orderkey // 256 = 3"), ("stride", "o_orderkey % 256 = 3")):
    query(f"flt05_chunk_{_mode}", "FLT-05", f"SELECT o_orderkey FROM orders WHERE {_cond}")(
        lambda spark, sf, m=_mode: orders(spark, sf)
        .where(Q.in_chunk(F.col("o_orderkey"), 3, mode=m)).select("o_orderkey"))


@query(
    "flt07_action_report",
    "FLT-07 FN-10",
    f"""WITH {LF}, a AS (SELECT l_returnflag AS tag, x0 / 20 AS a, x3 * 40 AS b, x2 * 11 AS c FROM lf)
    SELECT tag, count(*) AS n, count_if(NOT (a <= 2.0001 AND b <= pi() + 1e-4 AND c <= 1.0001))::BIGINT AS n_bad,
      bool_and(a <= 2.0001 AND b <= pi() + 1e-4 AND c <= 1.0001) AS ok,
      count_if(least(a, 2) <= 2 AND least(b, pi()) <= pi() AND least(c, 1) <= 1)::BIGINT AS n_clipped_ok
    FROM a GROUP BY 1""",
)
def _(spark, sf):
    z = F.lit(0.0)
    rows = line_frames(spark, sf, "l_returnflag").select(
        F.col("l_returnflag").alias("tag"),
        F.array(F.col("x0") / 20, z, z, F.col("x3") * 40, z, z, F.col("x2") * 11).alias("a"))
    rep = Q.action_report(rows, ["tag"], "a")
    clipped = rows.groupBy("tag").agg(
        F.count_if(V.canonical_ok(V.clip_canonical(F.col("a")))).alias("n_clipped_ok"))
    return rep.join(clipped, "tag")


@query(
    "flt12_existing_video",
    "FLT-12 SRC-13",
    """SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def _(spark, sf):
    have = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return Q.existing_only(orders(spark, sf), have, "o_orderkey").select("o_orderkey")


@query(
    "flt13_quarantine",
    "FLT-13",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
)
def _(spark, sf):
    bad = table(spark, sf, "labels").where("toxic = 1").select("doc_id")
    return Q.without_quarantined(table(spark, sf, "documents"), bad, "doc_id").select("doc_id")


@query(
    "flt14_table_report",
    "FLT-14 SET-03 SRC-19",
    """SELECT l_returnflag AS path, 'table' AS kind, false AS ok, 'missing column: proprio' AS error,
      count(*)::VARCHAR AS num_rows FROM lineitem GROUP BY 1""",
)
def _(spark, sf):
    rep = Q.table_report(table(spark, sf, "lineitem"), ["l_orderkey", "proprio"], F.col("l_returnflag"))
    return rep.select("path", "kind", "ok", F.array_join("errors", ";").alias("error"),
                      F.col("info")["num_rows"].alias("num_rows"))


@query(
    "agg08_pass_fail",
    "AGG-08",
    """SELECT event_type AS kind, count_if(value > 20)::BIGINT AS passed, count_if(value <= 20)::BIGINT AS failed
    FROM events GROUP BY 1""",
)
def _(spark, sf):
    ev = table(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.col("value") > 20).alias("ok"))
    return Q.pass_fail(ev, "kind", "ok")


# ---- sets ---------------------------------------------------------------------------------


@query(
    "set01_union_sources",
    "SET-01",
    f"""SELECT 'events' AS source, user_id AS episode, {R("value")} AS value, event_type AS text, NULL::BIGINT AS turn FROM events
    UNION ALL SELECT 'talk', conv_id, NULL, role, turn FROM conversations""",
)
def _(spark, sf):
    from epispark.sources.adapters import union_sources

    a = table(spark, sf, "events").select(
        F.lit("events").alias("source"), F.col("user_id").alias("episode"),
        r(F.col("value")).alias("value"), F.col("event_type").alias("text"))
    b = table(spark, sf, "conversations").select(
        F.lit("talk").alias("source"), F.col("conv_id").alias("episode"), F.col("role").alias("text"), "turn")
    return union_sources(a, b)


@query(
    "set02_merge_manifests",
    "SET-02 SNK-03 WIN-16",
    """WITH d AS (SELECT source || '-' || (doc_id // 3) AS episode_id, arg_max(doc_id, doc_id) AS last
      FROM documents GROUP BY 1)
    SELECT episode_id, last::VARCHAR AS raw_path, row_number() OVER (ORDER BY episode_id) - 1 AS episode_idx FROM d""",
)
def _(spark, sf):
    from epispark.sources.readers import merge_manifests

    d = table(spark, sf, "documents").select(
        F.concat_ws("-", "source", F.floor(F.col("doc_id") / 3).cast("string")).alias("episode_id"),
        F.lit("docs").alias("source"), F.lit("arm").alias("embodiment"),
        F.col("doc_id").cast("string").alias("raw_path"), F.lit(1).cast("long").alias("expected_n_frames"),
        F.lit("").alias("hash"), F.col("doc_id").alias("seq"))
    return merge_manifests(d, ["seq"]).select("episode_id", "raw_path", "episode_idx")


@query(
    "set04_ordered_union",
    "SET-04",
    """WITH m AS (SELECT l_shipmode AS key, min((l_suppkey, l_orderkey)) AS f FROM lineitem GROUP BY 1)
    SELECT key, f[1] AS dataset, f[2] AS ord FROM m""".replace("l_shipmode", "l_returnflag")
    .replace("min((l_suppkey, l_orderkey))", "min([l_suppkey, l_orderkey])"),
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("key"), F.col("l_suppkey").alias("dataset"), F.col("l_orderkey").alias("ord"))
    out = Q.ordered_union(li, "key", ["dataset", "ord"])
    return out.select("key", "first_seen.dataset", "first_seen.ord")


@query(
    "set05_shard_audit",
    "SET-05 SMP-10",
    """WITH s AS (SELECT l_orderkey, count(DISTINCT CASE WHEN l_orderkey % 97 = 5 THEN l_suppkey % 4
        ELSE l_orderkey % 4 END) AS n FROM lineitem GROUP BY 1)
    SELECT count_if(n > 1)::BIGINT AS n_overlapping, 0::BIGINT AS n_unassigned, count(*) AS n_items FROM s""",
)
def _(spark, sf):
    shard = F.when(F.col("l_orderkey") % 97 == 5, F.col("l_suppkey") % 4).otherwise(F.col("l_orderkey") % 4)
    return Q.shard_audit(table(spark, sf, "lineitem").withColumn("shard", shard), "l_orderkey", "shard")


@query(
    "set06_loss_and_duplicates",
    "SET-06",
    """WITH p AS (SELECT l_orderkey AS k, count(*) AS got FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1),
    b AS (SELECT coalesce(o_orderkey, k) AS k, CASE WHEN got IS NULL THEN 'lost' WHEN got > 1 THEN 'duplicate' END AS reason
      FROM orders FULL JOIN p ON k = o_orderkey) SELECT * FROM b WHERE reason IS NOT NULL""",
)
def _(spark, sf):
    want = orders(spark, sf).select(F.col("o_orderkey").alias("k"))
    got = table(spark, sf, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("k"))
    return Q.loss_and_duplicates(want, got, "k")


@query(
    "set07_same_members",
    "SET-07",
    """WITH d AS ((SELECT DISTINCT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer)
      UNION ALL (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders))
    SELECT count(*) = 0 AS same, count(*) AS n_different FROM d""",
)
def _(spark, sf):
    a = orders(spark, sf).select(F.col("o_custkey").alias("k"))
    return Q.same_members(a, table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), "k")


# ---- orderings ----------------------------------------------------------------------------


@query(
    "srt03_limit_chunks",
    "SRT-03",
    """SELECT o_orderkey // 256 AS chunk, count(*) AS n FROM orders WHERE o_orderkey // 256 >= 2 GROUP BY 1
    ORDER BY 1 LIMIT 3""",
)
def _(spark, sf):
    c = orders(spark, sf).groupBy(F.floor(F.col("o_orderkey") / 256).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    return Q.limit_chunks(c, "chunk", 2, 3)


@query(
    "srt04_plan_chunks",
    "SRT-04 AGG-09",
    """WITH f AS (SELECT source, text, doc_id, n_chars, (row_number() OVER (PARTITION BY lang ORDER BY source, doc_id) - 1) // 40 AS chunk_id, lang FROM documents)
    SELECT lang, chunk_id, count(*) AS n_files, sum(n_chars)::BIGINT AS total_bytes FROM f GROUP BY 1, 2""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("lang", "source", "doc_id", "n_chars")
    docs = docs.withColumn("path", F.format_string("%s/%012d", "source", "doc_id"))
    planned = Q.plan_chunks(docs, "lang", "path", 40)
    return Q.chunk_sizes(planned, "lang", "n_chars")


@query(
    "srt05_top_priority",
    "SRT-05 JN-09",
    f"""WITH {LEDGER_SQL} SELECT chunk, stage, status FROM g WHERE status IN ('pending', 'requeued')
      AND (SELECT count(*) FROM g p WHERE p.chunk = g.chunk AND p.stage < g.stage AND p.status = 'done') = g.stage
    ORDER BY stage, chunk LIMIT 20""",
)
def _(spark, sf):
    ready = J.ready_work(stage_ledger(spark, sf), ["chunk"], "stage", "status")
    return Q.top_priority(ready, ["stage", "chunk"], 20)


@query(
    "srt06_even_picks",
    "SRT-06",
    """WITH d AS (SELECT doc_id, n_chars AS len, greatest(4, least(8, round_even(n_chars / 400.0, 0)::INTEGER)) AS n
      FROM documents),
    p AS (SELECT DISTINCT doc_id, floor(i * ((len - 1) / (n - 1)))::BIGINT AS pick FROM d, unnest(range(n)) AS u(i))
    SELECT doc_id, pick FROM p""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.explode(Q.even_picks(F.col("n_chars"), F.lit(400.0))).alias("pick"))
    return d


@query(
    "srt07_subsample_rate",
    "SRT-07",
    f"""WITH {EV} SELECT event_id FROM ev WHERE frame % greatest(round_even((ARRAY[15, 5, 30, 25, 8])[episode % 5 + 1] / 5.0, 0)::BIGINT, 1) = 0""",
)
def _(spark, sf):
    src = F.get(F.array(*[F.lit(float(x)) for x in (15, 5, 30, 25, 8)]), (F.col("episode") % 5).cast("int"))
    return Q.subsample_rate(signal_frames(spark, sf), "frame", src, F.lit(5.0)).select("event_id")


@query(
    "srt08_keep_tokens",
    "SRT-08",
    f"""SELECT vec_id, 9::INTEGER AS n, {R("list_sum(embedding[1:9]::DOUBLE[])", 5)} AS total FROM embeddings""",
)
def _(spark, sf):
    kept = Q.keep_tokens(F.col("embedding"), 8)
    e = table(spark, sf, "embeddings").select("vec_id", kept.alias("k"))
    total = F.aggregate("k", F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.size("k").alias("n"), r(total, 5).alias("total"))


@query(
    "srt02_grippers_last",
    "SRT-02",
    """SELECT p_name, (row_number() OVER (ORDER BY p_partkey % 3 = 0, p_partkey) - 1) AS position FROM part""",
)
def _(spark, sf):
    p = table(spark, sf, "part").select(
        "p_name", "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, "left_gripper").otherwise("arm").alias("key"))
    ordered = Q.grippers_last(p, "key", "p_partkey")
    out = dense_index(
        ordered, [], [F.lower("key").contains("gripper"), "p_partkey"],
        [F.lower("key").contains("gripper"), F.floor(F.col("p_partkey") / 65536)], "position")
    return out.select("p_name", "position")
