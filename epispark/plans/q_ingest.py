"""Ingest queries: sources, sinks, ledger and adapters (SRC-*, SNK-*, PRJ-01..04, UDF-04/05).

File-layout queries write tables derived from the benchmark tables to the session's scratch folder
and read them back through the library's own readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.operators import quality as Q
from epispark.operators.stats import column_statistics
from epispark.plans.q_stats import six, six_sql
from epispark.plans.registry import R, query, r
from epispark.plans.views import EV, LF, line_frames, long_values, signal_frames, table
from epispark.session import materialise, scratch_path
from epispark.sources import adapters as AD
from epispark.sources import readers as RD
from epispark.sources import sinks as SK


def demo_frames(spark, sf):
    """Frames of the line episodes with a chunk number, the schema of a published data set."""
    return line_frames(spark, sf).select(
        F.col("episode").alias("episode_index"),
        F.col("frame").alias("frame_index"),
        (F.col("frame") / 15.0).alias("timestamp"),
        F.lit("arm").alias("embodiment"),
        F.array("x0", "x2", "x3").alias("proprio"),
        F.lit("lines").alias("source"),
        F.floor(F.col("episode") / 4096).alias("chunk"),
    )


# ---- listings -----------------------------------------------------------------------------


@query(
    "src01_list_tables",
    "SRC-01 SRT-01",
    """WITH t AS (SELECT DISTINCT 'records::episode_' || lpad(l_orderkey::VARCHAR, 12, '0') || '.json' AS episode_id
      FROM lineitem WHERE l_orderkey % 50 = 0)
    SELECT episode_id, row_number() OVER (ORDER BY episode_id) - 1 AS episode_idx,
      substr(sha256(episode_id), 1, 12) AS hash FROM t""",
)
def _(spark, sf):
    """Manifest of record files, which are first written from the line items."""
    from epispark.plans.q_deep import write_records

    root = write_records(spark, sf)
    files = RD.list_files(spark, root, "*.json")
    m = RD.manifest(files, "records", "none", RD.relative_path(F.col("path"), root))
    return m.select("episode_id", "episode_idx", "hash")


PATHS = r"""l AS (SELECT page_id, 'raw/' || CASE WHEN page_id % 11 = 0 THEN 'done/' ELSE '' END
    || regexp_replace(url, '^https?://([^/]*)/.*$', '\1') || '/data/chunk-00' || page_id % 3 || '/'
    || CASE WHEN page_id % 7 = 0 THEN '.tmp' ELSE 'episode_' || lpad(page_id::VARCHAR, 6, '0') || '.parquet' END AS path,
    len(html) AS length FROM pages)"""


def page_listing(spark, sf):
    """A listing whose paths come from the page addresses and whose sizes from the page texts."""
    host = F.regexp_replace("url", r"^https?://([^/]*)/.*$", "$1")
    name = F.when(F.col("page_id") % 7 == 0, F.lit(".tmp")).otherwise(
        F.format_string("episode_%06d.parquet", "page_id"))
    path = F.concat(
        F.lit("raw/"), F.when(F.col("page_id") % 11 == 0, "done/").otherwise(""), host,
        F.lit("/data/chunk-00"), (F.col("page_id") % 3).cast("string"), F.lit("/"), name)
    return table(spark, sf, "pages").select(
        "page_id", path.alias("path"), F.length("html").cast("long").alias("length"))


@query("flt06_payload_files", "FLT-06 SRC-05",
       f"WITH {PATHS} SELECT path, page_id AS episode FROM l WHERE page_id % 11 <> 0 AND page_id % 7 <> 0")
def _(spark, sf):
    kept = Q.payload_files(page_listing(spark, sf), F.col("path"))
    return kept.select("path", RD.episode_of_file(F.col("path")).alias("episode"))


@query(
    "src17_dataset_roots",
    "SRC-17",
    """WITH l AS (SELECT source || '/' || CASE doc_id % 4 WHEN 0 THEN 'test' || lang ELSE lang END
        || CASE WHEN lang = 'de' THEN '/sub' || doc_id % 2 ELSE '' END AS root, source AS name, lang, doc_id FROM documents
      WHERE source NOT IN ('src9')),
    f AS (SELECT source AS root, source AS name FROM documents WHERE source IN ('src1', 'src2'))
    SELECT DISTINCT root, name FROM f
    UNION SELECT DISTINCT root, name FROM l WHERE name NOT IN ('src1', 'src2') AND doc_id % 4 <> 0""",
)
def _(spark, sf):
    d = table(spark, sf, "documents")
    task = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("test"), "lang")).otherwise(F.col("lang"))
    sub = F.when(F.col("lang") == "de", F.concat(F.lit("/sub"), F.col("doc_id") % 2)).otherwise("")
    deep = d.select(F.concat("source", F.lit("/"), task, sub, F.lit("/data/f.parquet")).alias("path"))
    flat = d.where(F.col("source").isin("src1", "src2")).select(F.concat("source", F.lit("/data/f.parquet")).alias("path"))
    names = [f"src{i}" for i in range(20) if i != 9]
    roots = RD.dataset_roots(deep.unionByName(flat), F.col("path"), names)
    return roots.select("root", "name")


@query(
    "src18_task_roots",
    "SRC-18",
    f"""WITH {PATHS} SELECT regexp_extract(path, '^(.*?)/data/', 1) AS task, count(*) AS n_files, sum(length)::BIGINT AS bytes
    FROM l GROUP BY 1""",
)
def _(spark, sf):
    return page_listing(spark, sf).groupBy(RD.task_root(F.col("path")).alias("task")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"))


@query(
    "src19_output_tree",
    "SRC-19",
    """SELECT CASE page_id % 3 WHEN 0 THEN 'table' WHEN 1 THEN 'video' ELSE 'feature' END AS kind,
      CASE WHEN page_id % 3 > 0 THEN 'cam' || page_id % 4 END AS camera, count(*) AS n FROM pages GROUP BY 1, 2""",
)
def _(spark, sf):
    p = table(spark, sf, "pages")
    cam = (F.col("page_id") % 4).cast("string")
    path = (
        F.when(F.col("page_id") % 3 == 0, F.lit("o/data/chunk-000/e.parquet"))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("o/videos/chunk-000/cam"), cam, F.lit("/e.mp4")))
        .otherwise(F.concat(F.lit("o/features/cam"), cam, F.lit("/rgb/f.parquet"))))
    kind, camera = RD.classify_output(path)
    return p.groupBy(kind.alias("kind"), camera.alias("camera")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg09_folder_report",
    "AGG-09 FLT-06",
    """SELECT source AS folder, count(*) AS file_count, sum(n_chars)::BIGINT AS total_bytes, max(n_chars) AS largest_bytes,
      min(doc_id::VARCHAR) FILTER (n_chars = mx) AS largest_file, count_if(n_chars > 5000)::BIGINT AS n_oversized,
      count(*) <= 55 AND count_if(n_chars > 5000) = 0 AS ok
    FROM (SELECT *, max(n_chars) OVER (PARTITION BY source) AS mx FROM documents) GROUP BY source""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(
        F.col("source").alias("folder"), F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("length"))
    return Q.folder_report(d, "folder", max_files=55, max_bytes=5000)


@query(
    "agg22_space_by_category",
    "AGG-22",
    """SELECT CASE doc_id % 5 WHEN 0 THEN 'scratch' WHEN 1 THEN 'done_markers' WHEN 2 THEN 'depth_npy'
      WHEN 3 THEN 'depth_json' ELSE 'kept' END AS category, sum(n_chars)::BIGINT AS bytes, count(*) AS files
    FROM documents GROUP BY 1""",
)
def _(spark, sf):
    names = ["c/_scratch/a.bin", "c/done/h.ok", "c/ep_1/depth_head.npy", "c/ep_1/depth_head.json", "c/ep_1/camera_head.npy"]
    path = F.get(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 5).cast("int"))
    return Q.space_by_category(table(spark, sf, "documents"), path, "n_chars")


# ---- metadata -----------------------------------------------------------------------------


@query(
    "src03_episode_defaults",
    "SRC-03",
    """SELECT o_orderkey AS episode_index, o_custkey AS length, 0::INTEGER AS chunk, (o_orderkey % 3)::INTEGER AS file,
      CASE WHEN o_orderstatus = 'F' THEN 'unknown' ELSE o_orderstatus END AS embodiment FROM orders""",
)
def _(spark, sf):
    path = scratch_path(spark, "episodes")
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("episode_index"), F.col("o_custkey").alias("length"),
        (F.col("o_orderkey") % 3).alias("data/file_index"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("embodiment"))
    raw.write.json(path)
    return RD.read_episodes(spark, path)


@query(
    "src07_tasks_json_lines",
    "SRC-07 SRC-12",
    "SELECT p_partkey AS task_index, p_name AS task FROM part",
)
def _(spark, sf):
    path = scratch_path(spark, "tasks")
    table(spark, sf, "part").select(F.col("p_partkey").alias("task_index"), F.col("p_name").alias("task")).write.json(path)
    return RD.read_tasks(spark, path)


@query(
    "src08_modality_fields",
    "SRC-08 SRC-04",
    """SELECT p_partkey, 'state' AS grp, 'arm' AS key, 'observation.state' AS original_key, 0 AS start,
      (p_size % 7)::INTEGER AS "end", true AS absolute FROM part
    UNION ALL SELECT p_partkey, 'action', 'gripper', 'act', (p_size % 7)::INTEGER, (p_size % 7 + 1)::INTEGER, false FROM part""",
)
def _(spark, sf):
    doc = F.format_string(
        '{"state":{"arm":{"start":0,"end":%d}},"action":{"gripper":{"original_key":"act","start":%d,"end":%d,"absolute":false}}}',
        F.col("p_size") % 7, F.col("p_size") % 7, F.col("p_size") % 7 + 1)
    p = table(spark, sf, "part").select("p_partkey", doc.alias("doc"))
    fields = RD.modality_fields(p, "doc", "p_partkey")
    return fields.select("p_partkey", F.col("group").alias("grp"), "key", "original_key", "start", "end", "absolute")


@query(
    "src09_statistics_or_compute",
    "SRC-09 SNK-06 SRC-21",
    f"""WITH {LF}, u AS (SELECT unnest(['q', 'e', 'd', 't']) AS key, unnest([x0, x1, x2, x3]) AS value FROM lf)
    SELECT key, 0 AS dim, {six_sql()} FROM u GROUP BY 1""",
)
def _(spark, sf):
    rows = line_frames(spark, sf)
    names = F.array(*[F.lit(k) for k in ("q", "e", "d", "t")])
    values = long_values(rows, ["x0", "x1", "x2", "x3"]).withColumn("key", F.get(names, F.col("dim")))
    stats = column_statistics(values.select("key", "value"), ["key"]).withColumn("dim", F.lit(0))
    # the stored file has two of the four keys and one entry with a missing vector
    full = stats.withColumns({"tag": F.lit("arm"), "num_transitions": F.col("n"), "num_trajectories": F.lit(1)})
    path = scratch_path(spark, "statistics")
    SK.write_statistics(full.where("key in ('q', 'd')"), "tag", path)
    stored = RD.statistics_rows(
        spark.read.text(path).select(
            F.to_json(F.from_json("value", "statistics map<string,string>")["statistics"]).alias("raw"), "value"
        ).select(F.get_json_object("value", "$.statistics").alias("doc")), "doc")
    computed = stats.select("key", "dim", "mean", "std", "min", "max", "q01", "q99")
    out = RD.statistics_or_compute(stored, computed)
    return out.select("key", "dim", *six())


@query(
    "src10_tolerant_lines",
    "SRC-10",
    "SELECT event_id AS episode_index FROM events WHERE event_id % 3 <> 0",
)
def _(spark, sf):
    line = F.when(F.col("event_id") % 3 == 0, F.lit('{"episode_index": oops')).otherwise(
        F.format_string('{"episode_index": %d, "length": 5}', "event_id"))
    lines = table(spark, sf, "events").select(line.alias("value"))
    root = scratch_path(spark, "v2")
    lines.write.text(f"{root}/meta/episodes.jsonl")
    return RD.episodes_with_fallbacks(spark, root)


@query(
    "src11_clean_language",
    "SRC-11",
    """SELECT source || lang AS episode_id, arg_max(md5(text), doc_id) AS text FROM documents WHERE doc_id % 6 <> 0 GROUP BY 1""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").withColumn("md", F.md5(F.col("text").cast("binary")))
    alias = F.when(F.col("doc_id") % 2 == 0, F.lit('{"id":"%s%s","instruction":"%s"}')).otherwise(
        F.lit('{"episode_id":"%s%s","language_instruction":"%s"}'))
    body = F.when(F.col("doc_id") % 2 == 0,
                  F.format_string('{"id":"%s%s","instruction":"%s"}', "source", "lang", "md")).otherwise(
                  F.format_string('{"episode_id":"%s%s","language_instruction":"%s"}', "source", "lang", "md"))
    line = F.when(F.col("doc_id") % 6 == 0, F.lit("{broken")).otherwise(body)
    return RD.clean_language(d.select(line.alias("line"), "doc_id"), "line", ["doc_id"])


@query(
    "src12_conversation_annotations",
    "SRC-12",
    """SELECT 'a' AS data_path, count(*) AS n, sum(len(text))::BIGINT AS chars FROM conversations WHERE conv_id % 2 = 0
    UNION ALL SELECT 'b', count(*), sum(len(text))::BIGINT FROM conversations WHERE conv_id % 2 = 1""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations").select(
        "conv_id", F.array(F.struct(F.col("role").alias("from"), F.col("text").alias("value"))).alias("conversations"))
    paths = {}
    for rest, name in ((0, "a"), (1, "b")):
        p = scratch_path(spark, "talk")
        c.where(F.col("conv_id") % 2 == rest).drop("conv_id").write.json(p)
        paths[p] = name
    rows = RD.read_conversations(spark, paths)
    return rows.groupBy("data_path").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(F.col("conversations")[0]["value"])).alias("chars"))


@query(
    "src13_videos_with_sidecar",
    "SRC-13 FN-33",
    """SELECT 'v/' || page_id || '.mp4' AS path, (page_id % 30)::DOUBLE AS fps, len(html) AS size_bytes FROM pages WHERE page_id % 4 <> 1""",
)
def _(spark, sf):
    p = table(spark, sf, "pages")
    videos = p.select(F.format_string("v/%d.mp4", "page_id").alias("path"))
    side = p.where("page_id % 4 <> 1").select(
        F.format_string("v/%d.json", "page_id").alias("path"), (F.col("page_id") % 30).cast("double").alias("fps"),
        F.lit(1.0).alias("duration_sec"), F.length("html").cast("long").alias("size_bytes"))
    return RD.with_sidecar(videos, side).select("path", "fps", "size_bytes")


# ---- tables on disk -----------------------------------------------------------------------


@query(
    "snk01_idempotent_frames",
    "SNK-01 SNK-04 SNK-11 SRC-02 JN-07",
    f"""WITH {LF} SELECT episode AS episode_index, frame AS frame_index, {R("frame / 15.0")} AS timestamp,
      episode // 4096 AS chunk FROM lf""",
)
def _(spark, sf):
    out, ledger = scratch_path(spark, "frames"), scratch_path(spark, "ledger")
    frames = demo_frames(spark, sf)
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episode_index")).distinct()
    known = li.select(
        F.lit("lines").alias("source"), F.floor(F.col("episode_index") / 4096).alias("chunk"), "episode_index")
    SK.write_frames(frames.where("chunk <= 1"), out, ledger, episodes=known.where("chunk <= 1"))
    SK.write_frames(frames, out, ledger, episodes=known)  # chunks 0 and 1 are done and stay as they are
    SK.write_frames(frames, out, ledger, episodes=known)  # nothing left to do
    back = RD.read_frames(spark, out, columns=["episode_index", "frame_index", "timestamp", "chunk"])
    return back.withColumns({"timestamp": r(F.col("timestamp")), "chunk": F.col("chunk").cast("long")})


@query(
    "snk04_incremental_chunks",
    "SNK-01 SNK-04",
    f"""WITH {LF}, n AS (SELECT episode AS episode_index, count(*) AS frames, sum(frame)::BIGINT AS total FROM lf GROUP BY 1)
    SELECT episode_index, frames, total, true AS done FROM n
    UNION ALL SELECT -o_orderkey - 1, 0, 0, false FROM orders WHERE o_orderkey % 50 = 0""",
)
def _(spark, sf):
    """Every chunk grows in three increments; some episodes of the manifest have no frames."""
    out, ledger = scratch_path(spark, "frames"), scratch_path(spark, "ledger")
    frames = demo_frames(spark, sf)
    known = frames.select("source", "chunk", "episode_index").distinct()
    absent = table(spark, sf, "orders").where("o_orderkey % 50 = 0").select(
        F.lit("lines").alias("source"), F.lit(0).cast("long").alias("chunk"), (-F.col("o_orderkey") - 1).alias("episode_index"))
    known = known.select("source", F.col("chunk").cast("long").alias("chunk"), "episode_index").unionByName(absent)
    known = materialise(known, "manifest")
    for part in (0, 1):
        SK.write_frames(frames.where(F.col("episode_index") % 3 == part), out, ledger, episodes=known)
    SK.write_frames(frames, out, ledger, episodes=known)
    stored = RD.read_frames(spark, out, columns=["episode_index", "frame_index"]).groupBy("episode_index").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(F.col("frame_index").cast("long")).alias("total"))
    done = SK.finished(SK.read_ledger(spark, ledger)).select(
        F.col("item").cast("long").alias("episode_index"), F.lit(True).alias("done"))
    rows = known.select("episode_index").distinct().join(stored.hint("merge"), "episode_index", "left").join(
        done.hint("merge"), "episode_index", "left")
    return rows.select("episode_index", F.coalesce("frames", F.lit(0).cast("long")).alias("frames"),
                       F.coalesce("total", F.lit(0).cast("long")).alias("total"), F.coalesce("done", F.lit(False)).alias("done"))


@query(
    "snk02_roll_up",
    "SNK-02 AGG-24 FLT-02 SRC-03 SRC-04",
    f"""WITH {LF}, n AS (SELECT episode, count(*) AS n FROM lf GROUP BY 1 HAVING count(*) >= 4)
    SELECT episode AS episode_index, n AS length, (episode // 256)::INTEGER AS chunk, 0 AS file, 'arm' AS embodiment,
      (SELECT count(*) FROM n) AS n_episodes, (SELECT sum(n) FROM n)::BIGINT AS n_frames FROM n""",
)
def _(spark, sf):
    out = scratch_path(spark, "rollup")
    SK.roll_up(demo_frames(spark, sf).drop("chunk"), out, "lines", 256, 15, 5, min_frames=4)
    info = spark.read.json(f"{out}/meta/info").select(F.struct("n_episodes", "n_frames").alias("s")).scalar()
    ep = RD.read_episodes(spark, f"{out}/meta/episodes")
    return ep.withColumn("s", info).select(*ep.columns, "s.n_episodes", "s.n_frames")


@query(
    "src05_episode_files",
    "SRC-05",
    """SELECT user_id AS episode_index, count(*) AS n FROM events GROUP BY 1""",
)
def _(spark, sf):
    # one file per episode; its number is read back from the path
    out = scratch_path(spark, "v2files")
    ev = table(spark, sf, "events").withColumn("episode", F.col("user_id"))
    ev.repartition("episode").write.partitionBy("episode").parquet(out)
    files = RD.read_episode_files(spark, out, "*.parquet")
    return files.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src10_parquet_index",
    "SRC-10",
    "SELECT DISTINCT l_orderkey AS episode_index FROM lineitem",
)
def _(spark, sf):
    root = scratch_path(spark, "v3")
    keys = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("episode_index")).distinct()
    keys.write.parquet(f"{root}/meta/episodes")
    return RD.episodes_with_fallbacks(spark, root)


@query(
    "src10_file_names",
    "SRC-10 SRC-01",
    "SELECT DISTINCT user_id AS episode_index FROM events",
)
def _(spark, sf):
    root = scratch_path(spark, "v2")
    ev = table(spark, sf, "events").withColumn("episode", F.col("user_id"))
    ev.repartition("episode").write.partitionBy("episode").parquet(f"{root}/data")
    return RD.episodes_with_fallbacks(spark, root, "*.parquet")


@query(
    "src02_one_episode",
    "SRC-02",
    f"""WITH {LF} SELECT frame AS frame_index, {R("frame / 15.0")} AS timestamp FROM lf
    WHERE episode = (SELECT max(episode) FROM lf)""",
)
def _(spark, sf):
    out, ledger = scratch_path(spark, "frames"), scratch_path(spark, "ledger")
    SK.write_frames(demo_frames(spark, sf), out, ledger)
    last = table(spark, sf, "lineitem").agg(F.max("l_orderkey")).first()[0]
    rows = RD.read_frames(spark, out, episode=last, columns=["frame_index", "timestamp"])
    return rows.withColumn("timestamp", r(F.col("timestamp")))


@query(
    "snk03_manifest",
    "SNK-03",
    f"""WITH {PATHS}, k AS (SELECT 'pages::' || path AS episode_id FROM l WHERE page_id % 11 <> 0 AND page_id % 7 <> 0)
    SELECT episode_id, row_number() OVER (ORDER BY episode_id) - 1 AS episode_idx,
      substr(sha256(episode_id), 1, 12) AS hash FROM k""",
)
def _(spark, sf):
    out = scratch_path(spark, "manifest")
    files = Q.payload_files(page_listing(spark, sf), F.col("path"))
    SK.write_manifest(RD.manifest(files, "pages", "none", F.col("path")), out)
    return spark.read.parquet(out).select("episode_id", "episode_idx", "hash")


@query(
    "snk11_chunk_complete",
    "SNK-11",
    f"""WITH {LF} SELECT 'lines' AS source, episode // 4096 AS chunk, 'done' AS status, count(DISTINCT episode) AS n_episodes,
      count(*) AS n_frames, (24 * count(*))::BIGINT AS bytes, true AS timed FROM lf GROUP BY 2""",
)
def _(spark, sf):
    import time

    ledger, started = scratch_path(spark, "ledger"), time.time()
    SK.chunk_complete(demo_frames(spark, sf), ledger, F.size("proprio") * 8, started)
    rows = spark.read.parquet(ledger)
    return rows.select("source", "chunk", "status", "n_episodes", "n_frames", "bytes",
                       (F.col("elapsed_seconds") >= 0).alias("timed"))


@query(
    "src14_feature_shards",
    "SRC-14 SNK-08 FN-04",
    """SELECT label AS episode_index, count(*) AS t, 2::BIGINT AS n, 32::BIGINT AS d FROM embeddings GROUP BY 1""",
)
def _(spark, sf):
    from epispark.scale import dense_index

    e = dense_index(table(spark, sf, "embeddings"), ["label"], ["vec_id"], [F.floor(F.col("vec_id") / 65536)], "feat_idx")
    feats = e.select(
        F.lit("head").alias("camera"), F.lit("rgb").alias("modality"), F.floor(F.col("label") / 4).alias("chunk"),
        F.col("label").cast("long").alias("episode_index"), "feat_idx",
        F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)).alias("tokens"))
    out = scratch_path(spark, "features")
    SK.write_features(feats, out)
    index = RD.feature_index(RD.read_features(spark, out, camera="head", modality="rgb"))
    return index.select(F.col("episode_index").cast("int").alias("episode_index"), "t", "n", "d")


@query(
    "snk09_cached_index",
    "SNK-09 WIN-07",
    "SELECT user_id AS episode, unnest(range(0, n, 5)) AS t FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)",
)
def _(spark, sf):
    from epispark.operators.windows import every_interval

    n = table(spark, sf, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count(F.lit(1)).alias("n"))
    root = scratch_path(spark, "steps")
    build = lambda: every_interval(n, "episode", "n", 5)
    SK.cached_table(spark, root, {"interval": 5, "source": "events"}, build)
    return SK.cached_table(spark, root, {"source": "events", "interval": 5}, build)


@query(
    "snk10_publish_changed",
    "SNK-10 UDF-10 JN-08",
    """SELECT o_orderkey // 500 AS chunk, CASE WHEN o_orderkey // 500 <= 1 THEN 3 ELSE 1 END::BIGINT AS uploads
    FROM orders GROUP BY ALL""",
)
def _(spark, sf):
    state, sent = scratch_path(spark, "state"), scratch_path(spark, "sent")
    chunks = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 500).alias("chunk")).agg(
        F.sum("o_custkey").cast("string").alias("h"))
    upload = lambda df: df.select("chunk").write.mode("append").parquet(sent)
    some = chunks.where("chunk <= 1")
    SK.publish_changed(some, state, ["chunk"], "h", upload)
    SK.publish_changed(some.withColumn("h", F.concat("h", F.lit("x"))), state, ["chunk"], "h", upload)
    SK.publish_changed(chunks, state, ["chunk"], "h", upload)  # the first content again, and new chunks
    SK.publish_changed(chunks, state, ["chunk"], "h", upload)  # nothing has changed
    return spark.read.parquet(sent).groupBy("chunk").agg(F.count(F.lit(1)).alias("uploads"))


@query(
    "snk05_validation_report",
    "SNK-05 FLT-14 AGG-08",
    """SELECT event_type AS path, true AS ok, count(*)::VARCHAR AS num_rows FROM events GROUP BY 1""",
)
def _(spark, sf):
    rep = Q.table_report(table(spark, sf, "events"), ["user_id", "ts"], F.col("event_type"))
    out = scratch_path(spark, "report")
    SK.write_report(rep, out)
    back = spark.read.schema("path string, kind string, ok boolean, errors array<string>, info map<string,string>").json(out)
    return back.select("path", "ok", F.col("info")["num_rows"].alias("num_rows"))


@query(
    "snk07_delta_statistics_file",
    "SNK-07",
    f"""WITH {LF}, u AS (SELECT unnest([0, 1]) AS dim, unnest([x2, x3]) AS value FROM lf)
    SELECT 'eef.left' AS key, dim, {six_sql()} FROM u GROUP BY dim""",
)
def _(spark, sf):
    stats = column_statistics(long_values(line_frames(spark, sf), ["x2", "x3"]), ["dim"])
    full = stats.withColumns({"tag": F.lit("task"), "key": F.lit("eef.left"), "num_transitions": F.col("n"),
                              "num_trajectories": F.lit(1).cast("long")})
    out = scratch_path(spark, "delta")
    SK.write_statistics(full.withColumn("num_transitions", F.lit(0)), "tag", out)
    doc = spark.read.text(out).select(F.get_json_object("value", "$.statistics").alias("doc"))
    return RD.statistics_rows(doc, "doc").select("key", "dim", *six())


@query(
    "snk12_evaluation_artefacts",
    "SNK-12",
    f"""WITH {LF} SELECT episode AS traj_id, frame AS step, {R("abs(x2 - x3)")} AS err FROM lf""",
)
def _(spark, sf):
    rows = line_frames(spark, sf).select(
        F.col("episode").alias("traj_id"), F.col("frame").alias("step"), F.abs(F.col("x2") - F.col("x3")).alias("err"))
    out = scratch_path(spark, "eval")
    SK.write_evaluation(rows, out)
    return spark.read.parquet(out).withColumn("err", r(F.col("err")))


# ---- adapters -----------------------------------------------------------------------------


def _exploded(frames):
    """Frame vectors reduced to comparable scalars."""
    c = F.col
    return frames.select(
        "episode_index", "frame_index", r(c("timestamp")).alias("timestamp"), "embodiment",
        *[r(c("action_native")[i].cast("double"), 3).alias(f"a{i}") for i in (0, 3, 6, 7)],
        r(c("action_canonical_ee")[0].cast("double"), 3).alias("ee0"),
        r(c("proprio")[1].cast("double"), 3).alias("s1"),
        F.size(F.filter("action_mask", lambda m: m)).alias("n_action"),
        F.size(F.filter("state_mask", lambda m: m)).alias("n_state"),
        F.size("proprio").alias("w_state"), F.size("action_native").alias("w_action"),
        "level_1", "level_2", "subtask_label")


def _frame_sql(ts, emb, a0, a3, a6, a7, ee0, s1, na, ns, l1, l2="''", sub="false"):
    f = lambda x: R(f"(({x})::FLOAT)::DOUBLE", 3)
    return (f"episode AS episode_index, frame AS frame_index, {R(ts)} AS timestamp, '{emb}' AS embodiment, "
            f"{f(a0)} AS a0, {f(a3)} AS a3, {f(a6)} AS a6, {f(a7)} AS a7, {f(ee0)} AS ee0, {f(s1)} AS s1, "
            f"{na}::INTEGER AS n_action, {ns}::INTEGER AS n_state, 50 AS w_state, 32 AS w_action, "
            f"{l1} AS level_1, {l2} AS level_2, {sub} AS subtask_label")


@query(
    "prj01_arm_velocity_frames",
    "PRJ-01 SRC-15 UDF-04 JN-01",
    f"""WITH {LF} SELECT {_frame_sql("frame / 15.0", "droid_franka", "x2", "x3", "x2 * 10", "0", "x2", "x3", 7, 14,
      "CASE WHEN episode % 5 = 0 THEN 'clean' || episode ELSE 'raw' || episode END")} FROM lf""",
)
def _(spark, sf):
    rows = line_frames(spark, sf)
    z, d = F.lit(0.0), lambda *c: F.array(*[F.col(x) if isinstance(x, str) else x for x in c])
    obs = F.struct(
        d("x0", "x3", z, z, z, z, z).alias("joint_position"), d("x2").alias("gripper_position"),
        d("x0", "x2", "x3", z, z, z).alias("cartesian_position"))
    step = F.struct(obs.alias("observation"), d("x2", z, z, "x3", z, z, F.col("x2") * 10, F.lit(9.0)).alias("action"),
                    F.concat(F.lit("raw"), "episode").cast("binary").alias("language_instruction"))
    # raw episodes arrive as records of consecutive steps; short ones, so that most have several
    raw = rows.groupBy(F.col("episode").alias("episode_index"), F.floor(F.col("frame") / 3).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("frame", step.alias("s")))).alias("a"))
    raw = raw.select("episode_index", F.col("episode_index").cast("string").alias("episode_id"),
                     (F.col("part") * 3).alias("first_frame"), F.col("a.s").alias("steps"))
    clean = table(spark, sf, "orders").where("o_orderkey % 5 = 0").select(
        F.col("o_orderkey").cast("string").alias("episode_id"), F.concat(F.lit("clean"), "o_orderkey").alias("text"))
    return _exploded(AD.ArmVelocityAdapter(clean).to_frames(raw))


@query(
    "prj02_delta_pose_frames",
    "PRJ-02 SRC-15 UDF-04",
    f"""WITH {LF} SELECT {_frame_sql("frame / 5.0", "bridge_widowx", "least(x0 / 10, 2)", "x3 * 10", "least(CASE WHEN ln % 3 = 0 THEN 0 ELSE x2 * 20 END, 1)", "0",
      "least(x0 / 10, 2)", "CASE WHEN ln % 2 = 0 THEN x3 ELSE 0 END", 7, "CASE WHEN ln % 2 = 0 THEN 8 ELSE 7 END", "'say' || episode")} FROM lf""",
)
def _(spark, sf):
    rows = line_frames(spark, sf)
    z, null = F.lit(0.0), F.lit(None).cast("array<double>")
    a = F.col("x0") / 10, F.col("x3") * 10, F.col("x2") * 20
    flat = F.array(a[0], z, z, a[1], z, z, F.when(F.col("ln") % 3 == 0, z).otherwise(a[2]), z)
    grip = F.array(a[2])
    parts = F.struct(
        F.array(a[0], z, z).alias("world_vector"), F.array(a[1], z, z).alias("rotation_delta"),
        F.when(F.col("ln") % 3 == 1, grip).otherwise(null).alias("open_gripper"),
        F.when(F.col("ln") % 3 == 2, grip).otherwise(null).alias("gripper_closedness_action"))
    step = F.struct(
        F.when(F.col("ln") % 2 == 0, flat).otherwise(null).alias("action_flat"), parts.alias("action_parts"),
        F.when(F.col("ln") % 2 == 0, F.array("x0", "x3", z, z, z, z, z, z)).otherwise(null).alias("state"),
        F.lit(None).cast("string").alias("language_instruction"),
        F.concat(F.lit("say"), "episode").alias("natural_language_instruction"))
    raw = rows.groupBy(F.col("episode").alias("episode_index"), F.floor(F.col("frame") / 3).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("frame", step.alias("s")))).alias("a"))
    return _exploded(AD.DeltaPoseAdapter().to_frames(raw.select(
        "episode_index", (F.col("part") * 3).alias("first_frame"), F.col("a.s").alias("steps"))))


VEL = "least(greatest(coalesce(lead({0}) OVER w - {0}, {0} - lag({0}) OVER w, 0) * {1}, -2), 2)"


@query(
    "prj03_bimanual_frames",
    "PRJ-03 JN-03 WIN-03 FN-32 UDF-04",
    f"""WITH {EV}, n AS (SELECT episode, count(*) AS t FROM ev GROUP BY 1), v AS (SELECT *, value / 1000 AS p FROM ev JOIN n USING (episode))
    SELECT {_frame_sql("frame / 30.0", "agibot_g1", VEL.format("p", 30), "0", "least(value / 100, 1)", "value / 7", VEL.format("p", 30), "value / 9",
      31, 50, "'pick' || episode", "CASE WHEN frame < t // 2 THEN 'approach' ELSE 'grasp' END", "frame = t // 2 AND frame > 0")}
    FROM v WINDOW w AS (PARTITION BY episode ORDER BY frame)""",
)
def _(spark, sf):
    ev = signal_frames(spark, sf)
    n = table(spark, sf, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count(F.lit(1)).alias("t"))
    z = F.lit(0.0)
    state = [z] * 50
    state[1], state[14], state[20] = F.col("value") / 9, F.col("value") / 1000, F.col("value") / 100
    half = F.floor(F.col("t") / 2)
    seg = F.format_string('[{"start":0,"end":%d,"level_2":"approach"},{"start":%d,"level_2":"grasp"}]', half, half)
    raw = ev.join(n, "episode").select(
        F.col("episode").alias("episode_index"), F.col("frame").alias("frame_index"),
        F.lit(None).cast("double").alias("timestamp"), F.concat(F.lit("pick"), "episode").alias("task"),
        F.array(*state).alias("state"), F.array(F.col("value") / 7, *[z] * 23).alias("action"),
        F.when(F.col("frame") == 0, seg).alias("segments"))
    return _exploded(AD.BimanualSegmentAdapter().to_frames(raw))


@query(
    "prj04_joint_position_frames",
    "PRJ-04 SRC-16 FN-05 UDF-04 FLT-01",
    f"""WITH {EV}, v AS (SELECT ('0x' || substr(sha256('ep' || episode), 1, 12))::BIGINT % 2147483647 AS episode, frame, value, event_id,
        CASE WHEN episode % 2 = 0 THEN value / 500 ELSE 0 END AS p, episode AS user FROM ev)
    SELECT {_frame_sql("frame / 25.0", "robomind_tien_kung", VEL.format("p", 25), "0", "CASE WHEN user % 2 = 0 THEN least(value / 100, 1) ELSE 0 END", "value / 7",
      VEL.format("p", 25), "value / 9", 21, 14, "'do' || user")} FROM v WINDOW w AS (PARTITION BY user ORDER BY frame)""",
)
def _(spark, sf):
    z = F.lit(0.0)
    none = F.lit(None).cast("array<double>")
    even = F.col("episode") % 2 == 0
    act = F.array(F.col("value") / 7, *[z] * 13)
    joints = F.array(z, F.col("value") / 9, *[z] * 12)
    pose = F.when(even, F.array(F.col("value") / 500, *[z] * 5, F.col("value") / 100))
    text = F.concat(F.lit("do"), "episode").cast("binary")
    raw = signal_frames(spark, sf).select(
        F.concat(F.lit("ep"), "episode").alias("episode_id"), F.col("frame").alias("frame_index"),
        F.when(even, act).otherwise(none).alias("actions"),
        F.struct(F.when(even, none).otherwise(act).alias("joint_position")).alias("master"),
        F.struct(F.when(even, joints).otherwise(none).alias("joint_position"), pose.alias("ee_pose")).alias("observations"),
        F.struct(F.when(even, none).otherwise(joints).alias("joint_position")).alias("puppet"),
        F.when(even, text).alias("language_instruction"), F.when(~even, text).alias("language_raw"))
    return _exploded(AD.JointPositionAdapter().to_frames(raw))


@query("udf05_enumerator_override", "UDF-05 SRC-01",
       "SELECT 'docs::' || source || '/' || doc_id AS episode_id, doc_id AS seq FROM documents")
def _(spark, sf):
    def from_table(session, root):
        d = table(session, root, "documents")
        return d.select(F.concat(F.lit("docs::"), "source", F.lit("/"), "doc_id").alias("episode_id"), F.col("doc_id").alias("seq"))

    return AD.enumerate_source(spark, "arm_velocity", sf, enumerator=from_table)
