"""Scalar function queries (FN-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.functions import augment as A
from epispark.functions import ids as I
from epispark.functions import rotation as RT
from epispark.functions import text as X
from epispark.functions import vectors as V
from epispark.operators import quality as Q
from epispark.plans.q_windows import PI, u_sql, wrap_sql
from epispark.plans.registry import R, query, r
from epispark.plans.views import EV, LF, line_frames, signal_frames, table
from epispark.scale import global_rank
from epispark.streaming.trigger import should_refresh


@query(
    "fn01_hashes",
    "FN-01 FN-02 FN-05",
    """SELECT doc_id, substr(sha256(source || '::' || doc_id), 1, 12) AS episode_hash,
      substr(sha1(source || ':' || lang || ':' || doc_id), 1, 12) AS filename_hash,
      ('0x' || substr(sha256(source || '::' || doc_id), 1, 12))::BIGINT % 2147483647 AS id
    FROM documents""",
)
def _(spark, sf):
    key = F.concat("source", F.lit("::"), "doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", I.episode_hash(key).alias("episode_hash"),
        I.filename_hash(F.col("source"), F.col("lang"), F.col("doc_id")).alias("filename_hash"),
        I.id_from_hash(key).alias("id"))


@query(
    "fn03_index_set_hash",
    "FN-03 AGG-10",
    """SELECT o_orderkey // 64 AS chunk,
      substr(sha1('[' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || ']'), 1, 6) AS set_hash
    FROM orders GROUP BY 1""",
)
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 64).alias("chunk")).agg(
        I.index_set_hash(F.collect_list("o_orderkey")).alias("set_hash"))


@query(
    "agg10_id_set_hash",
    "AGG-10 AGG-11",
    """WITH d AS (SELECT doc_id // 64 AS chunk, source || '/' || doc_id AS id, n_chars, doc_id FROM documents)
    SELECT chunk, substr(sha256(string_agg(id, chr(10) ORDER BY id)), 1, 12) AS hash,
      substr(sha256(string_agg(id || '|' || n_chars || '|' || doc_id * 7, chr(10) ORDER BY id)), 1, 16) AS listing
    FROM d GROUP BY 1""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(
        F.floor(F.col("doc_id") / 64).alias("chunk"), F.concat_ws("/", "source", "doc_id").alias("id"),
        "n_chars", (F.col("doc_id") * 7).alias("mtime"))
    a = Q.id_set_hash(d, ["chunk"], "id")
    b = Q.listing_hash(d, ["chunk"], "id", "n_chars", "mtime").withColumnRenamed("hash", "listing")
    return a.join(b, "chunk")


@query(
    "fn04_episode_keys",
    "FN-04",
    """SELECT page_id, 'ep_' || lpad(page_id::VARCHAR, greatest(8, len(page_id::VARCHAR))::INTEGER, '0') AS key,
      CASE WHEN page_id % 3 <> 0 THEN page_id END AS parsed FROM pages""",
)
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", I.episode_key(F.col("page_id")).alias("key"))
    text = F.when(F.col("page_id") % 3 == 0, F.concat("key", F.lit("x"))).otherwise(F.col("key"))
    return p.withColumn("parsed", I.parse_episode_key(text))


@query(
    "fn06_readable_id",
    "FN-06 SRC-05",
    r"""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') || CASE page_id % 3
        WHEN 0 THEN '/data/trajectory.h5' WHEN 1 THEN '/trajectory.h5' ELSE '/run.7.h5' END AS path FROM pages)
    SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'run.7'
      ELSE regexp_extract(regexp_replace(regexp_replace(path, '/[^/]*$', ''), '(/data)+$', ''), '([^/]*)$', 1) END AS id
    FROM p""",
)
def _(spark, sf):
    tail = (F.when(F.col("page_id") % 3 == 0, "/data/trajectory.h5")
            .when(F.col("page_id") % 3 == 1, "/trajectory.h5").otherwise("/run.7.h5"))
    path = F.concat(F.regexp_replace("url", "^https?://", ""), tail)
    return table(spark, sf, "pages").select("page_id", I.readable_id(path).alias("id"))


@query(
    "fn07_path_template",
    "FN-07 SRC-04",
    """SELECT p.page_id, printf('videos/chunk-%03d/head/episode_%06d.mp4', floor(page_id / 100)::BIGINT, page_id) AS path
    FROM pages p""",
)
def _(spark, sf):
    tmpl = "videos/chunk-{episode_chunk:03d}/{video_key}/episode_{episode_index:06d}.mp4"
    path = I.fill_template(
        tmpl, episode_chunk=I.chunk_of(F.col("page_id"), 100), video_key=F.lit("head"),
        episode_index=F.col("page_id"))
    return table(spark, sf, "pages").select("page_id", path.alias("path"))


@query(
    "fn08_decode_text",
    "FN-08",
    "SELECT doc_id, md5(text) AS digest FROM documents",
)
def _(spark, sf):
    # two invalid bytes are put in front of every text and must disappear
    raw = F.concat(F.unhex(F.lit("FFFE")), F.col("text").cast("binary"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(X.decode_text(raw).cast("binary")).alias("digest"))


@query(
    "fn09_preview",
    "FN-09",
    """SELECT conv_id, turn, substr(trim(replace(text, chr(10), ' ')), 1, 48) AS preview FROM conversations""",
)
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.preview(F.col("text")).alias("preview"))


@query(
    "fn10_clip_keeps_nan",
    "FN-10",
    f"""WITH {LF} SELECT episode, frame, {R("least(greatest(x0 - 25, -2), 2)")} AS c0,
      {R("least(greatest(x3 * 100 - 4, -pi()), pi())")} AS c3, {R("least(greatest(x2 * 20, 0), 1)")} AS c6,
      sk % 5 = 0 AS nan_kept FROM lf""",
)
def _(spark, sf):
    z = F.lit(0.0)
    nan = F.when(F.col("sk") % 5 == 0, F.lit(float("nan"))).otherwise(z)
    v = F.array(F.col("x0") - 25, nan, z, F.col("x3") * 100 - 4, z, z, F.col("x2") * 20)
    rows = line_frames(spark, sf).withColumn("c", V.clip_canonical(v))
    return rows.select("episode", "frame", r(F.col("c")[0]).alias("c0"), r(F.col("c")[3]).alias("c3"),
                       r(F.col("c")[6]).alias("c6"), F.isnan(F.col("c")[1]).alias("nan_kept"))


@query(
    "fn11_angular_diff",
    "FN-11 WIN-02",
    f"""WITH {LF} SELECT episode, frame, {R(wrap_sql("x0 - x3 * 100"))} AS diff FROM lf""",
)
def _(spark, sf):
    return line_frames(spark, sf).select(
        "episode", "frame", r(V.angular_diff(F.col("x0"), F.col("x3") * 100)).alias("diff"))


@query(
    "fn12_first_seven",
    "FN-12",
    f"""WITH {LF} SELECT episode, frame, {R("least(x0 * 0.1, 2)")} AS c0, {R("least(x2 * 2, pi())")} AS c3 FROM lf""",
)
def _(spark, sf):
    z = F.lit(0.0)
    v = F.array("x0", z, z, "x2", z, z, z, "x1")
    rows = line_frames(spark, sf).withColumn("c", V.first_seven(v, [0.1, 1, 1, 2, 1, 1, 1]))
    return rows.select("episode", "frame", r(F.col("c")[0]).alias("c0"), r(F.col("c")[3]).alias("c3"))


@query(
    "fn19_perturb",
    "FN-19",
    f"""WITH {LF}, u AS (SELECT episode, frame, unnest([0, 1, 2]) AS i, unnest([x2, x3, x0 / 50]) AS x,
        least(x2, x3, x0 / 50) AS lo, greatest(x2, x3, x0 / 50) AS hi FROM lf)
    SELECT episode, frame, i, {R(f'''least(greatest(x + 0.05 * sqrt(-2 * ln(1 - {u_sql("3", "episode", "frame", "i", "'r'")}))
      * cos(2 * pi() * {u_sql("3", "episode", "frame", "i", "'phi'")}), lo), hi)''')} AS y FROM u""",
)
def _(spark, sf):
    v = F.array(F.col("x2"), F.col("x3"), F.col("x0") / 50)
    rows = line_frames(spark, sf).select(
        "episode", "frame", F.array_min(v).alias("lo"), F.array_max(v).alias("hi"), F.posexplode(v).alias("i", "x"))
    y = A.jitter(F.col("x"), F.col("lo"), F.col("hi"), 0.05, 3, F.col("episode"), F.col("frame"), F.col("i"))
    return rows.select("episode", "frame", "i", r(y).alias("y"))


@query(
    "fn20_dropout",
    "FN-20",
    f"""WITH {LF} SELECT episode, frame, {R(f"CASE WHEN {u_sql('5', 'episode', 'frame')} < 0.3 THEN 0 ELSE x0 END")} AS y FROM lf""",
)
def _(spark, sf):
    v = A.dropout(F.array("x0", "x2"), 0.3, 5, F.col("episode"), F.col("frame"))
    return line_frames(spark, sf).select("episode", "frame", r(v[0]).alias("y"))


@query(
    "fn21_rotation_chain",
    "FN-21 UDF-02",
    f"""WITH {LF} SELECT episode, frame, {R("x0 / 20 - 1.2", 5)} AS e0, {R("x2 * 10 - 0.5", 5)} AS e1,
      {R("x3 * 30 - 1.1", 5)} AS e2, {R("cos(x3 * 30 - 1.1) * cos(x2 * 10 - 0.5)", 5)} AS m00 FROM lf""",
)
def _(spark, sf):
    e = F.array(F.col("x3") * 30 - 1.1, F.col("x2") * 10 - 0.5, F.col("x0") / 20 - 1.2)
    q = RT.convert_rotation(e, "euler_angles_ypr", "quaternion")
    rows = line_frames(spark, sf).select("episode", "frame", q.alias("q"))
    rows = rows.withColumn("six", RT.convert_rotation(F.col("q"), "quaternion", "rotation_6d"))
    rows = rows.withColumn("aa", RT.convert_rotation(F.col("six"), "rotation_6d", "axis_angle"))
    rows = rows.withColumn("m", RT.convert_rotation(F.col("aa"), "axis_angle", "matrix"))
    rows = rows.withColumn("e", RT.convert_rotation(F.col("m"), "matrix", "euler_angles_ypr"))
    return rows.select("episode", "frame", r(F.col("e")[2], 5).alias("e0"), r(F.col("e")[1], 5).alias("e1"),
                       r(F.col("e")[0], 5).alias("e2"), r(F.col("m")[0], 5).alias("m00"))


@query(
    "fn22_gimbal_branch",
    "FN-22",
    f"""WITH {LF} SELECT episode, frame, {R("cos(x2 * 10 - x3 * 10)", 5)} AS cr, 0.0::DOUBLE AS yaw,
      {R("pi() / 2", 5)} AS pitch FROM lf""",
)
def _(spark, sf):
    m = RT.rpy_to_matrix(F.col("x2") * 10, F.lit(1.5707963267948966), F.col("x3") * 10)
    roll, pitch, yaw = RT.matrix_to_rpy(m)
    return line_frames(spark, sf).select(
        "episode", "frame", r(F.cos(roll), 5).alias("cr"), r(yaw, 5).alias("yaw"), r(pitch, 5).alias("pitch"))


@query(
    "fn23_invert_pose",
    "FN-23",
    f"""WITH {LF} SELECT episode, frame, {R("x2", 5)} AS tx, {R("x3", 5)} AS ty, {R("x0", 5)} AS tz FROM lf""",
)
def _(spark, sf):
    # inverting twice gives the pose back
    m = RT.rpy_to_matrix(F.col("x2") * 5, F.col("x3") * 5, F.col("x0") / 10)
    rows = line_frames(spark, sf).withColumns({f"m{i}{j}": m[i][j] for i in range(3) for j in range(3)})
    mat = [[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)]
    inv, pos = RT.invert_pose(mat, [F.col("x2"), F.col("x3"), F.col("x0")])
    rows = rows.withColumns({"p0": pos[0], "p1": pos[1], "p2": pos[2]})
    _, back = RT.invert_pose(inv, [F.col("p0"), F.col("p1"), F.col("p2")])
    return rows.select("episode", "frame", *[r(b, 5).alias(n) for b, n in zip(back, ("tx", "ty", "tz"))])


@query(
    "fn24_cosine_distance",
    "FN-24",
    f"""SELECT a.vec_id, {R('''1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
      (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))''')} AS dist
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id").select(
        "vec_id", r(V.cosine_distance(F.col("embedding"), F.col("b"))).alias("dist"))


@query(
    "fn25_refresh_predicate",
    "FN-25",
    f"""WITH {EV}, x AS (SELECT episode, frame, value / 400 AS d, frame - frame % 37 - CASE WHEN frame < 3 THEN 1 ELSE 0 END AS last,
        CASE WHEN event_type = 'signup' AND value > 100 THEN 1.0 ELSE -1.0 END AS logit FROM ev)
    SELECT episode, frame, frame = 0 OR last < 0 OR frame - last >= 60 OR d > 0.2
      OR (d > 0.06 AND frame - last >= 30) OR logit > 0 AS fire FROM x""",
)
def _(spark, sf):
    t = F.col("frame")
    last = t - t % 37 - F.when(t < 3, 1).otherwise(0)
    logit = F.when((F.col("event_type") == "signup") & (F.col("value") > 100), 1.0).otherwise(-1.0)
    return signal_frames(spark, sf).select(
        "episode", "frame", should_refresh(t, F.col("value") / 400, last, logit).alias("fire"))


@query(
    "fn26_project_point",
    "FN-26",
    f"""WITH {LF}, z AS (SELECT *, CASE WHEN sk % 4 = 0 THEN 1e-9 * (x2 - 0.05) ELSE x0 END AS zz FROM lf),
    d AS (SELECT *, CASE WHEN abs(zz) < 1e-4 THEN CASE WHEN zz >= 0 THEN 1e-4 ELSE -1e-4 END ELSE zz END AS dd FROM z)
    SELECT episode, frame, {R("600.0 * x2 / dd + 320", 4)} AS u, {R("600.0 * x3 / dd + 240", 4)} AS v FROM d""",
)
def _(spark, sf):
    z = F.when(F.col("sk") % 4 == 0, 1e-9 * (F.col("x2") - 0.05)).otherwise(F.col("x0"))
    rows = line_frames(spark, sf).withColumn("z", z)
    u, v = RT.project_point(600.0, 600.0, 320, 240, F.col("x2"), F.col("x3"), F.col("z"), eps=1e-4)
    return rows.select("episode", "frame", r(u, 4).alias("u"), r(v, 4).alias("v"))


# ---- conversations ------------------------------------------------------------------------


def talks(spark, sf):
    """Turn rows with the roles put back to their raw names."""
    raw = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    return table(spark, sf, "conversations").withColumn("role", raw)


WORDS = r"CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+')) END"


@query(
    "fn27_conversation_lengths",
    "FN-27 FLT-04",
    f"""WITH c AS (SELECT conv_id, sum({WORDS})::BIGINT AS w FROM conversations GROUP BY 1)
    SELECT conv_id, w AS words, (w + CASE WHEN conv_id % 2 = 0 THEN 128 ELSE 0 END)::BIGINT AS length,
      (CASE WHEN conv_id % 2 = 0 THEN w ELSE -w END)::BIGINT AS signed FROM c WHERE w <= 120""",
)
def _(spark, sf):
    rows = X.words_per_conversation(talks(spark, sf), "conv_id", "text").where("words <= 120")
    length, signed = X.signed_length(F.col("words"), F.col("conv_id") % 2 == 0)
    return rows.select("conv_id", "words", length.alias("length"), signed.alias("signed"))


@query(
    "fn28_normalise_turns",
    "FN-28",
    """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
        first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS r0 FROM conversations)
    SELECT conv_id, turn, role, md5(text) AS digest
    FROM t WHERE NOT (rn = 1 AND r0 <> 'user')""",
)
def _(spark, sf):
    out = X.user_first(talks(spark, sf), "conv_id", "turn", "role")
    return out.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "fn29_expand_tags",
    "FN-29",
    """SELECT conv_id, turn, 'a<s>' || repeat('<p>', (turn % 3)::INTEGER) || '<e>b<s>' || repeat('<p>', 2) || '<e>c<s><e>'
      || md5(text) AS content FROM conversations""",
)
def _(spark, sf):
    text = F.concat(F.lit("a<image>b<image>c<image>"), F.md5(F.col("text").cast("binary")))
    pads = F.array((F.col("turn") % 3).cast("int"), F.lit(2))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.expand_tags(text, "<image>", pads, "<s>", "<p>", "<e>").alias("content"))


@query(
    "fn30_target_mask",
    "FN-30",
    f"""WITH c AS (SELECT conv_id, turn, role, {WORDS} AS n FROM conversations)
    SELECT conv_id, turn, n::INTEGER AS n, (CASE WHEN role = 'assistant' THEN greatest(n - 3, 0) ELSE 0 END)::INTEGER AS n_targets,
      (CASE WHEN n = 0 THEN NULL WHEN role = 'assistant' AND n > 3 THEN n ELSE -100 END)::INTEGER AS last FROM c""",
)
def _(spark, sf):
    # stand-in tokenizer: the running number of the word
    c = table(spark, sf, "conversations").withColumn("n", X.word_count(F.col("text")))
    words = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    mask = X.target_mask(F.col("role"), words)
    c = c.withColumn("m", mask)
    return c.select("conv_id", "turn", F.size("m").alias("n"),
                    F.size(F.filter("m", lambda x: x != X.IGNORE)).alias("n_targets"),
                    F.try_element_at("m", F.lit(-1)).alias("last"))


@query(
    "fn31_json_span",
    "FN-31",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract(props, '$.k')::BIGINT END AS k FROM events""",
)
def _(spark, sf):
    noisy = F.when(F.col("event_id") % 5 == 0, F.lit("no object here")).otherwise(
        F.concat(F.lit("answer:\n"), "props", F.lit("\nend")))
    return table(spark, sf, "events").select("event_id", X.parse_json_span(noisy, "k long")["k"].alias("k"))


@query(
    "fn32_parse_segments",
    "FN-32",
    "SELECT event_id, (CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END)::INTEGER AS n_segments FROM events",
)
def _(spark, sf):
    good = F.format_string('[{"start":%d,"end":9},{"start":9,"level_2":"grasp"}]', F.col("event_id") % 7)
    text = F.when(F.col("event_id") % 8 == 0, F.lit("[broken")).when(
        F.col("event_id") % 8 == 4, F.lit(None).cast("string")).otherwise(good)
    return table(spark, sf, "events").select("event_id", F.size(X.parse_segments(text)).alias("n_segments"))


@query(
    "fn33_stored_frames",
    "FN-33",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN n_chars // 100 ELSE round_even(2.5 * (n_chars % 50), 0)::BIGINT END AS frames
    FROM documents""",
)
def _(spark, sf):
    secs = F.when(F.col("doc_id") % 3 != 0, (F.col("n_chars") % 50).cast("double"))
    return table(spark, sf, "documents").select(
        "doc_id", X.stored_frames(F.lit(2.5), secs, F.col("n_chars"), 100).alias("frames"))


@query(
    "fn34_millimetres",
    "FN-34",
    f"WITH {LF} SELECT episode, frame, trunc(least(greatest((x0 / 7 - 1) * 1000, 0), 5000))::INTEGER AS mm FROM lf",
)
def _(spark, sf):
    return line_frames(spark, sf).select("episode", "frame", V.to_millimetres(F.col("x0") / 7 - 1).alias("mm"))


@query(
    "fn35_reverse_channels",
    "FN-35",
    f"""SELECT vec_id, p::INTEGER AS p, {R("embedding[p * 3 + 3]::DOUBLE")} AS c0, {R("embedding[p * 3 + 1]::DOUBLE")} AS c2
    FROM embeddings CROSS JOIN (SELECT unnest(range(21)) AS p)""",
)
def _(spark, sf):
    pix = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.slice("embedding", i * 3 + 1, 3))
    out = table(spark, sf, "embeddings").select("vec_id", F.posexplode(V.reverse_channels(pix)).alias("p", "x"))
    return out.select("vec_id", "p", r(F.col("x")[0].cast("double")).alias("c0"), r(F.col("x")[2].cast("double")).alias("c2"))


@query(
    "fn37_fingerprint",
    "FN-37",
    """WITH t AS (SELECT l_orderkey // 32 AS batch, CASE WHEN l_linenumber = 1 THEN 'text' ELSE
        printf('%.4f,%.4f', l_discount, l_tax) END AS c FROM lineitem)
    SELECT batch, count(DISTINCT sha1(c)) AS n_distinct, max(sha1(c)) AS top FROM t GROUP BY 1""",
)
def _(spark, sf):
    v = F.when(F.col("l_linenumber") != 1, F.array(F.col("l_discount").cast("double"), F.col("l_tax").cast("double")))
    fp = I.fingerprint(v, F.lit("text"))
    return table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_orderkey") / 32).alias("batch")).agg(
        F.count_distinct(fp).alias("n_distinct"), F.max(fp).alias("top"))


def tokens(spark, sf):
    """Token arrays per document: the running number of each word."""
    d = table(spark, sf, "documents").select("doc_id", X.word_count(F.col("text")).alias("n"))
    return d.select("doc_id", "n", F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(
        F.array().cast("array<int>")).alias("tokens"))


WORDCTE = f"d AS (SELECT doc_id, doc_id // 16 AS batch, {WORDS} AS n FROM documents)"


@query(
    "fn39_pad_batches",
    "FN-39",
    f"""WITH {WORDCTE} SELECT doc_id, batch, max(n) OVER (PARTITION BY batch)::INTEGER AS width, n::INTEGER AS n_real,
      (CASE WHEN n < max(n) OVER (PARTITION BY batch) THEN 0 ELSE n END)::INTEGER AS last FROM d""",
)
def _(spark, sf):
    t = Q.assign_batches(tokens(spark, sf), "doc_id", 16)
    out = Q.pad_batches(t, "batch", "tokens", 0)
    return out.select("doc_id", "batch", F.size("input_ids").alias("width"),
                      F.size(F.filter("attention_mask", lambda b: b)).alias("n_real"),
                      F.coalesce(F.try_element_at("input_ids", F.lit(-1)), F.lit(0)).alias("last"))


@query(
    "fn39_pack_batches",
    "FN-39 WIN-17",
    f"""WITH {WORDCTE} SELECT batch, (row_number() OVER w - 1)::INTEGER AS pos,
      coalesce(sum(n) OVER (PARTITION BY batch ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start,
      sum(n) OVER (PARTITION BY batch)::INTEGER AS total FROM d WINDOW w AS (PARTITION BY batch ORDER BY doc_id)""",
)
def _(spark, sf):
    t = Q.assign_batches(tokens(spark, sf), "doc_id", 16)
    out = Q.pack_batches(t, "batch", "doc_id", "tokens")
    out = out.select("batch", F.size("input_ids").alias("total"), F.size("cu_seqlens").alias("k"),
                     F.posexplode("cu_seqlens").alias("pos", "start"))
    return out.where(F.col("pos") < F.col("k") - 1).drop("k")


@query(
    "fn40_collate",
    "FN-40",
    f"""WITH {LF}, b AS (SELECT *, (row_number() OVER (ORDER BY episode, frame) - 1) // 64 AS batch FROM lf)
    SELECT batch, count(*)::INTEGER AS n_rows, count(DISTINCT frame % 2) = 1 AS stacked,
      {R("sum(x0)", 4)} AS total FROM b GROUP BY 1""",
)
def _(spark, sf):
    # vectors have one or two entries, depending on the frame; a batch is 64 consecutive rows
    v = F.when(F.col("frame") % 2 == 0, F.array("x0")).otherwise(F.array(F.col("x0"), F.lit(0.0)))
    rows = line_frames(spark, sf).select("episode", "frame", v.alias("v"))
    rows = global_rank(rows, ["episode", "frame"], "i")
    rows = Q.assign_batches(rows.withColumn("o", F.struct("episode", "frame")), "i", 64)
    out = Q.collate_vectors(rows, "batch", "o", "v")
    total = F.aggregate("rows", F.lit(0.0), lambda s, x: s + x[0])
    return out.select("batch", F.size("rows").alias("n_rows"), "stacked", r(total, 4).alias("total"))
