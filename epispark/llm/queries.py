"""The dealt operators over the driver's tables: thin ``opN_<name>`` queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    """Register ``fn(spark, sf_dir)`` under its own name."""
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf, "documents"), tokenizer_path())


@query
def op9_piece_codec(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.piece_codec import round_trip

    return round_trip(table(spark, sf, "documents"), tokenizer_path())


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


@query
def op1_mixture(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.mixing import mix
    from epispark.llm.words import word_count

    mixed = mix(table(spark, sf, "documents"), word_count("text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op1_mixture"] = f"""
WITH d AS (
  SELECT doc_id, source, len({WORDS_SQL})::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (
        ORDER BY (source IS NULL), source COLLATE "C") - 1) % 3 + 1]::DOUBLE AS w FROM t),
l AS (SELECT *, ((SELECT sum(source_size) FROM t)::DOUBLE * 1.5
         - coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2.0)
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM r WINDOW o AS (ORDER BY source_size / w, source NULLS FIRST)),
g AS (SELECT source, source_size,
             least(source_size::DOUBLE * 2.0, w * (SELECT max(level) FROM l)) AS target FROM l),
c AS (SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS goal,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, goal - a)) + greatest(0, least(size, goal - source_size - a)))::BIGINT AS taken
FROM c"""


@query
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.quality_rules import filter_quality

    return filter_quality(table(spark, sf, "documents"))


ORACLES["op2_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) > 2),
dup AS (SELECT doc_id, i FROM (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (1 * (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
  + 4 * (word_chars < 2 * n_words)::INT + 8 * (word_chars > 25 * n_words)::INT
  + 16 * (5 * n_symbols > n_words)::INT + 32 * (100 * n_dup_lines > 50 * n_lines)::INT
  + 64 * (100 * n_upper > 40 * word_chars)::INT)::BIGINT AS failed_bits FROM m)
SELECT *, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept FROM b"""


@query
def op6_warc(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.warc import archive_digest, write_archive
    from epispark.session import scratch_path

    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf, "pages"), path)
    return archive_digest(spark, path)


@query
def op3_exact_topk(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.topk import top_k

    vectors = table(spark, sf, "embeddings")
    return top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLES["op3_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@query
def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf, "documents"))


@query
def op7_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The digest, and ``passage_words``: words in passages of over 50 words that repeat, however short."""
    from epispark.llm.suffix_dedup import dedup_digest, passage_words

    docs = table(spark, sf, "documents")
    words = passage_words(docs).groupBy(F.col("id").alias("i")).agg(F.sum("passage_words").alias("passage_words"))
    rows = dedup_digest(docs).join(words, F.expr("doc_id <=> i"), "left").drop("i")
    return rows.withColumn("passage_words", F.coalesce("passage_words", F.lit(0)).cast("long"))


@query
def op8_quality_model(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.quality_model import score_quality

    return score_quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op10_language_model(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.language_model import score_texts

    return score_texts(table(spark, sf, "documents"))


#: Unsigned crc32 in SQL: eight shifts of every byte as a table, then one step per byte of the hex text.
CRC_TABLE_SQL = """SELECT list(c ORDER BY b) AS crc_table FROM (
    SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x:
      CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS b))"""


def crc_sql(text: str) -> str:
    """Crc32 of a non-empty text; ``crc_table`` must be in scope."""
    digits = f"hex(encode({text}))"
    return f"""xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, length({digits}) // 2),
        lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::BIGINT)),
      lambda a, x: xor(a >> 8, crc_table[xor(a & 255, x) + 1])), 4294967295)"""


@query
def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.merkle import verify_manifest

    return verify_manifest(table(spark, sf, "documents"))


def _leaf_sql(text: str) -> str:
    part = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
    return "sha256(" + " || ".join(part.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLES["op11_merkle"] = f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS cut,
             {crc_sql("doc_id::VARCHAR")} % 2 = 0 AS hit FROM documents, crc),
l AS (SELECT *, CASE WHEN hit THEN cut ELSE leaf END AS shown,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
        count(*) OVER (PARTITION BY source) AS n FROM d),
low AS (SELECT source, 0 AS lvl, r AS i, n, leaf AS h FROM l
  UNION ALL SELECT source, lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM low WHERE n > 1 GROUP BY source, lvl, i // 3, n),
s AS (SELECT source, lvl AS height, h AS subroot,
        row_number() OVER (ORDER BY source COLLATE "C" NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS lvl, r AS i, n, subroot AS h FROM s
  UNION ALL SELECT lvl + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i))
  FROM high WHERE n > 1 GROUP BY lvl, i // 3, n),
steps AS (
  SELECT l.source, l.doc_id, l.r, x.lvl,
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < l.r // (3 ** x.lvl)::BIGINT), '') AS a,
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > l.r // (3 ** x.lvl)::BIGINT), '') AS b
  FROM l JOIN low x ON x.source IS NOT DISTINCT FROM l.source AND x.n > 1 AND x.i // 3 = l.r // (3 ** (x.lvl + 1))::BIGINT
  GROUP BY ALL
  UNION ALL
  SELECT l.source, l.doc_id, l.r, s.height + x.lvl,
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i < s.r // (3 ** x.lvl)::BIGINT), ''),
         coalesce(string_agg(x.h, '' ORDER BY x.i) FILTER (x.i > s.r // (3 ** x.lvl)::BIGINT), '')
  FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN high x ON x.n > 1 AND x.i // 3 = s.r // (3 ** (x.lvl + 1))::BIGINT
  GROUP BY ALL),
paths AS (SELECT source, r, list({{'a': a, 'b': b}} ORDER BY lvl) AS p, string_agg(a || b, '' ORDER BY lvl) AS q
          FROM steps GROUP BY source, r),
f AS (SELECT source, r, 0 AS k, shown AS h FROM l
  UNION ALL SELECT f.source, f.r, k + 1, sha256(p[k + 1].a || h || p[k + 1].b)
  FROM f JOIN paths ON paths.source IS NOT DISTINCT FROM f.source AND paths.r = f.r WHERE k < len(p)),
top AS (SELECT h AS root FROM high WHERE n = 1),
e AS (SELECT l.doc_id, l.leaf, s.subroot, top.root, sha256(coalesce(q, '')) AS proof_sha256, f.h AS folded_root
  FROM l CROSS JOIN top JOIN s ON s.source IS NOT DISTINCT FROM l.source
  LEFT JOIN paths ON paths.source IS NOT DISTINCT FROM l.source AND paths.r = l.r
  JOIN f ON f.source IS NOT DISTINCT FROM l.source AND f.r = l.r AND f.k = coalesce(len(p), 0))
SELECT *, folded_root = root AS verified FROM e"""


@query
def op12_minhash(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.minhash import minhash_duplicates

    return minhash_duplicates(table(spark, sf, "documents"))


ORACLES["op12_minhash"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w
           ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
rows AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM rows a JOIN rows b USING (x) WHERE a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS c FROM sets UNION SELECT b, c FROM reach JOIN ends ON a = doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept
FROM sets JOIN (SELECT doc_id, min(c) AS m FROM reach GROUP BY doc_id) USING (doc_id)"""


@query
def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    from epispark.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf, "documents"))


ORACLES["op13_spelling"] = f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
c AS (SELECT doc_id, run, count(*) AS k FROM (
        SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
      GROUP BY doc_id, run),
l AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, k
      FROM c WHERE length(run) >= 6),
h AS (SELECT run, k, {crc_sql("doc_id || ':' || run")} AS h FROM l, crc),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
             ELSE run END AS word, k FROM h),
g AS (SELECT word, sum(k)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, CASE WHEN i = 0 THEN word ELSE substr(word, 1, i - 1) || substr(word, i + 1) END AS x
        FROM (SELECT word, n, unnest(range(length(word) + 1)) AS i FROM g)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (x)
      WHERE a.word <> b.word AND ((a.i = 0) <> (b.i = 0) OR a.i = b.i)),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near,
           arg_min(near, (-near_n, near COLLATE "C")) AS near, max(near_n) AS near_n FROM p GROUP BY word),
o AS (SELECT g.word, CASE WHEN near_n >= 5 * g.n THEN near END AS form, g.n, coalesce(n_near, 0)::BIGINT AS n_near,
        CASE WHEN near_n >= 5 * g.n THEN near_n END::BIGINT AS form_n FROM g LEFT JOIN best USING (word)),
way AS (SELECT word, word AS at FROM o UNION ALL SELECT way.word, o.form FROM way JOIN o ON o.word = way.at WHERE o.form IS NOT NULL)
SELECT o.word, o.form, way.at AS root, o.n, o.n_near, o.form_n
FROM o JOIN way USING (word) JOIN o z ON z.word = way.at AND z.form IS NULL"""
