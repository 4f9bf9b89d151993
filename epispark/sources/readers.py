"""Readers: listings, episodic tables and their JSON metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epispark import schemas
from epispark.functions.ids import short_sha256
from epispark.scale import global_rank

# fixed values: file patterns of the raw episode formats, one file per episode
RAW_GLOBS = {"table": "*.parquet", "hierarchical": "*.h5", "records": "*.tfrecord*"}


LISTING_TASKS = 128


def few_listing_tasks(spark: SparkSession) -> None:
    """Lets a listing take ``LISTING_TASKS`` tasks at most; Spark's default is a task a folder up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    if int(spark.conf.get(name)) > LISTING_TASKS:
        spark.conf.set(name, LISTING_TASKS)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Recursive listing ``path, length, modificationTime``; contents are never read.

    A missing root is an empty listing.
    """
    few_listing_tasks(spark)
    try:
        files = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true")
            .load(root)
        )
    except AnalysisException as err:
        if "PATH_NOT_FOUND" not in str(err):
            raise
        return spark.createDataFrame([], schemas.ddl(schemas.LISTING_COLUMNS))
    return files.select("path", "length", "modificationTime")


def relative_path(path: Column, root: str) -> Column:
    plain = F.regexp_replace(path, r"^file:/+", "/")
    clean = root.rstrip("/") + "/"
    return F.when(plain.startswith(clean), F.substr(plain, F.lit(len(clean) + 1))).otherwise(plain)


def manifest(listing: DataFrame, source: str, embodiment: str, rel: Column) -> DataFrame:
    """One row per raw episode with a dense index in id order; id is ``source::relative path``.
    """
    rows = listing.select(
        F.concat(F.lit(source + "::"), rel).alias("episode_id"),
        F.lit(source).alias("source"),
        F.lit(embodiment).alias("embodiment"),
        F.col("path").alias("raw_path"),
        F.lit(None).cast("long").alias("expected_n_frames"),
    ).withColumn("hash", short_sha256(F.col("episode_id")))
    return index_manifest(rows)


def index_manifest(rows: DataFrame) -> DataFrame:
    """Dense 0-based ``episode_idx`` by episode id (binary string order)."""
    return global_rank(rows, ["episode_id"], "episode_idx").select(*schemas.MANIFEST_COLUMNS)


def merge_manifests(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """De-duplicate by episode id (the last row in ``order`` wins) and index again."""
    others = [c for c in rows.columns if c not in ("episode_id", "episode_idx", *order)]
    last = rows.groupBy("episode_id").agg(
        F.max_by(F.struct(*others), F.struct(*order)).alias("r")
    )
    return index_manifest(last.select("episode_id", "r.*"))


def read_frames(
    spark: SparkSession, path: str, episode: int | None = None, columns: Sequence[str] = ()
) -> DataFrame:
    """Frame table, optionally of one episode; filter and projection reach the parquet scan."""
    df = spark.read.parquet(path)
    if episode is not None:
        df = df.where(F.col("episode_index") == episode)
    return df.select(*columns) if columns else df


def with_default_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add missing columns and fill nulls with default values."""
    out = {
        name: F.coalesce(F.col(name), value) if name in df.columns else value
        for name, value in defaults.items()
    }
    return df.withColumns(out)


def read_episodes(spark: SparkSession, path: str) -> DataFrame:
    """Episode metadata from parquet, else JSON lines; ordered by index, defaults filled in."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    raw = spark.read.parquet(path) if found.inputFiles() else spark.read.json(path)
    return episode_defaults(raw).orderBy("episode_index")


def episode_defaults(raw: DataFrame) -> DataFrame:
    """Chunk and file 0, embodiment ``unknown`` where absent."""

    def pick(*names: str, default) -> Column:
        found = [F.col(f"`{n}`") for n in names if n in raw.columns]
        return F.coalesce(*found, F.lit(default))

    return raw.select(
        F.col("episode_index").cast("long").alias("episode_index"),
        F.col("length").cast("long").alias("length"),
        pick("chunk", "data/chunk_index", default=0).cast("int").alias("chunk"),
        pick("file", "data/file_index", default=0).cast("int").alias("file"),
        pick("embodiment", default="unknown").alias("embodiment"),
    )


def read_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INFO).option("multiLine", True).json(path)


def read_tasks(spark: SparkSession, path: str, table: bool = False) -> DataFrame:
    """Task dictionary from JSON lines, or from a parquet table."""
    if table:
        return spark.read.parquet(path).select("task_index", "task")
    return spark.read.schema(schemas.TASKS).json(path)


def episode_of_file(path: Column) -> Column:
    """Episode number in a per-episode file name, or folder name where Spark wrote the file."""
    name = r"episode[_=](\d+)(?:\.[^/]*)?(?:/part-[^/]*)?$"
    return F.regexp_extract(path, name, 1).try_cast("long")


def read_episode_files(spark: SparkSession, root: str, pattern: str = "episode_*.parquet"):
    """Layout with one file per episode; the episode number comes from the file name."""
    few_listing_tasks(spark)
    df = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .parquet(root)
    )
    return df.withColumn("episode_index", episode_of_file(F.col("_metadata.file_path")))


def shift_timestamps(frames: DataFrame, episodes: DataFrame) -> DataFrame:
    """Layout with many episodes per file: add each episode's start offset to its timestamps."""
    starts = episodes.select("episode_index", "from_timestamp")
    return (
        frames.join(starts, "episode_index")
        .withColumn("timestamp", F.col("timestamp") + F.col("from_timestamp"))
        .drop("from_timestamp")
    )


def modality_fields(text: DataFrame, column: str, *keep: str) -> DataFrame:
    """Modality JSON text to one row per field: ``group, key, original_key, start, end, ...``.

    ``original_key`` defaults to the observation state or the action column; ``keep`` names columns
    that identify the document when there are several.
    """
    m = F.from_json(column, schemas.MODALITY)
    parts = []
    for group, default in (("state", "observation.state"), ("action", "action")):
        fields = text.select(*keep, F.explode(m[group]).alias("key", "f"))
        parts.append(
            fields.select(
                *keep,
                F.lit(group).alias("group"),
                "key",
                F.coalesce("f.original_key", F.lit(default)).alias("original_key"),
                "f.start",
                "f.end",
                F.coalesce("f.absolute", F.lit(True)).alias("absolute"),
                "f.rotation_type",
                F.coalesce("f.dtype", F.lit("float64")).alias("dtype"),
            )
        )
    return parts[0].unionByName(parts[1])


def field_of(fields: DataFrame, dotted: str) -> DataFrame:
    """Typed metadata of one ``group.key``; an unknown key gives no row."""
    group, key = dotted.split(".", 1)
    return fields.where((F.col("group") == group) & (F.col("key") == key))


def statistics_rows(text: DataFrame, column: str) -> DataFrame:
    """Statistics JSON text to ``key, dim, mean, std, min, max, q01, q99`` rows.

    A key whose six vectors are missing or of unequal length is dropped.
    """
    parsed = F.from_json(column, f"map<string,{schemas.STATISTICS_ENTRY}>")
    entries = text.select(F.explode(parsed).alias("key", "s"))
    names = ["mean", "std", "min", "max", "q01", "q99"]
    valid = F.lit(True)
    for n in names:
        valid = valid & F.coalesce(F.size(f"s.{n}") == F.size("s.mean"), F.lit(False))
    zipped = F.arrays_zip(*[F.col(f"s.{n}").alias(n) for n in names])
    return entries.where(valid).select("key", F.posexplode(zipped).alias("dim", "z")).select(
        "key", "dim", *[F.col(f"z.{n}").alias(n) for n in names]
    )


def statistics_or_compute(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """Stored statistics, and computed ones for the keys the stored file lacks."""
    return stored.unionByName(computed.join(stored.select("key").distinct(), "key", "left_anti"))


def tolerant_json(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Parsed JSON lines; lines that do not parse to a struct with its first field are dropped."""
    first = T.StructType.fromDDL(schema).fieldNames()[0]
    rows = lines.select(F.from_json(column, schema, {"mode": "PERMISSIVE"}).alias("j"))
    return rows.where(F.col(f"j.`{first}`").isNotNull()).select("j.*")


def episodes_with_fallbacks(
    spark: SparkSession, root: str, pattern: str = "episode_*.parquet"
) -> DataFrame:
    """Episode numbers from the parquet index, else the JSON lines file, else the file names.

    Only an absent file leads on to the next form; an index without its column is an error.
    """

    def present(read, path: str) -> DataFrame | None:
        try:
            return read(path)
        except AnalysisException as err:
            if "PATH_NOT_FOUND" not in str(err):
                raise
            return None

    for path in (f"{root}/meta/episodes.parquet", f"{root}/meta/episodes"):
        index = present(spark.read.parquet, path)
        if index is not None:
            return index.select(F.col("episode_index").cast("long"))
    lines = present(spark.read.text, f"{root}/meta/episodes.jsonl")
    if lines is not None:
        return tolerant_json(lines, "value", "episode_index long").select("episode_index")
    files = list_files(spark, f"{root}/data", pattern)
    numbers = files.select(episode_of_file(F.col("path")).alias("episode_index"))
    return numbers.where("episode_index is not null").distinct()


LANGUAGE_LINE = (
    "episode_id string, id string, language_instruction string, instruction string"
)


def clean_language(lines: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """``episode_id -> text`` from JSON lines with key aliases; bad lines dropped, last one wins."""
    j = F.from_json(column, LANGUAGE_LINE)
    rows = lines.select(
        F.coalesce(j["episode_id"], j["id"]).alias("episode_id"),
        F.coalesce(j["language_instruction"], j["instruction"]).alias("text"),
        *order,
    ).where("episode_id is not null and text is not null")
    return rows.groupBy("episode_id").agg(F.max_by("text", F.struct(*order)).alias("text"))


CONVERSATION = (
    "conversations array<struct<`from`:string,value:string>>, images array<string>, "
    "videos array<string>, num_tokens long"
)


def read_conversations(
    spark: SparkSession, sources: dict[str, str], multiline: bool = False
) -> DataFrame:
    """Conversation annotations of several files (JSON array or lines), each with its data path."""
    out = None
    for annotation, data_path in sources.items():
        df = (
            spark.read.schema(CONVERSATION)
            .option("multiLine", multiline)
            .json(annotation)
            .withColumn("data_path", F.lit(data_path))
        )
        out = df if out is None else out.unionByName(df)
    return out


def with_sidecar(videos: DataFrame, sidecars: DataFrame, path: str = "path") -> DataFrame:
    """Videos that have a metadata sidecar of the same stem, with its fps, duration and size."""
    stem = F.regexp_replace(F.col(path), r"\.[^./]*$", "")
    meta = sidecars.select(
        F.regexp_replace(F.col(path), r"\.[^./]*$", "").alias("__stem"),
        "fps",
        "duration_sec",
        "size_bytes",
    )
    return videos.withColumn("__stem", stem).join(meta, "__stem").drop("__stem")


def registry_rules(text: DataFrame, column: str) -> DataFrame:
    """Embodiment registry JSON text to one rule row per embodiment."""
    j = F.from_json(column, schemas.REGISTRY)
    return text.select(F.explode(j["embodiments"]).alias("embodiment", "rule")).select(
        "embodiment", "rule.*"
    )


def dataset_roots(listing: DataFrame, rel: Column, names: Sequence[str]) -> DataFrame:
    """Dataset roots of a mixture: ``name``, ``name/task`` or ``name/task/sub`` whichever holds a
    ``data`` folder first; a task folder whose name contains ``test`` is skipped."""
    m = F.regexp_extract(rel, r"^((?:[^/]+/){1,3}?)data/", 1)
    root = F.rtrim(m, F.lit("/"))
    parts = F.split(root, "/")
    rows = (
        listing.select(root.alias("root"), parts.alias("p"))
        .where((F.col("root") != "") & F.col("p")[0].isin(*names))
        .where((F.size("p") == 1) | ~F.get("p", F.lit(1)).contains("test"))
        .select("root", F.col("p")[0].alias("name"), F.size("p").alias("depth"))
        .distinct()
    )
    # the shallowest level with a data folder decides below a common parent
    parent = F.when(F.col("depth") <= 2, F.col("name")).otherwise(
        F.substring_index("root", "/", 2)
    )
    flat = rows.where("depth = 1").select("name").distinct()
    deeper = rows.join(flat.withColumn("flat", F.lit(True)), "name", "left").where(
        (F.col("depth") == 1) | F.col("flat").isNull()
    )
    second = rows.where("depth = 2").select(F.col("root").alias("parent"), F.lit(True).alias("hit"))
    return (
        deeper.withColumn("parent", parent)
        .join(second, "parent", "left")
        .where((F.col("depth") < 3) | F.col("hit").isNull())
        .select("root", "name", "depth")
    )


def task_root(path: Column) -> Column:
    """Parent of the first ``data`` folder on a path (empty when there is none)."""
    return F.regexp_extract(path, r"^(.*?)/data/", 1)


def classify_output(path: Column) -> tuple[Column, Column]:
    """Kind of an output file (table, video, feature) and its camera key, if any."""
    kind = (
        F.when(path.rlike(r"/data/.*\.parquet$"), "table")
        .when(path.rlike(r"/videos/.*\.mp4$"), "video")
        .when(path.rlike(r"/features/.*\.(safetensors|parquet)$"), "feature")
    )
    camera = F.regexp_extract(path, r"/(?:videos|features)/(?:chunk-\d+/)?([^/]+)/", 1)
    return kind, F.when(camera != "", camera)


def read_features(
    spark: SparkSession, path: str, camera: str | None = None, modality: str | None = None,
    episode: int | None = None, idx: Sequence[int] = (),
) -> DataFrame:
    """Feature rows by camera, modality, episode and frame positions (all pushed to the scan)."""
    df = spark.read.parquet(path)
    if camera is not None:
        df = df.where(F.col("camera") == camera)
    if modality is not None:
        df = df.where(F.col("modality") == modality)
    if episode is not None:
        df = df.where(F.col("episode_index") == episode)
    return df.where(F.col("feat_idx").isin(*idx)) if idx else df


def feature_index(features: DataFrame) -> DataFrame:
    """``(T, N, D)`` per camera, modality and episode."""
    return features.groupBy("camera", "modality", "episode_index").agg(
        F.count(F.lit(1)).alias("t"),
        F.max(F.size("tokens")).cast("long").alias("n"),
        F.max(F.size(F.get("tokens", F.lit(0)))).cast("long").alias("d"),
    )


def distinct_first(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """First row of each key in ordinal order."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
