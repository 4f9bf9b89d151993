"""Mixture and sampling queries (SMP-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from epispark.operators import sampling as S
from epispark.operators.windows import global_index
from epispark.plans.q_windows import u_sql
from epispark.plans.registry import R, query, r
from epispark.plans.views import table


def mixture(spark, sf):
    """One dataset per part brand: weight from the brand, items = number of parts."""
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(
        F.sum("p_size").cast("double").alias("weight"), F.count(F.lit(1)).alias("items"))


MIX = """m AS (SELECT p_brand AS name, sum(p_size)::DOUBLE AS weight, count(*) AS items FROM part GROUP BY 1)"""


@query("smp01_normalise_weights", "SMP-01",
       f"WITH {MIX} SELECT name, {R('weight / sum(weight) OVER ()')} AS weight FROM m")
def _(spark, sf):
    return S.normalise_weights(mixture(spark, sf)).select("name", r(F.col("weight")).alias("weight"))


@query("flt08_filter_mixture", "FLT-08",
       f"""WITH {MIX}, f AS (SELECT * FROM m WHERE name IN ('Brand#1', 'Brand#11', 'Brand#2', 'Brand#21', 'Brand#12'))
       SELECT name, {R('weight / sum(weight) OVER ()')} AS weight FROM f""")
def _(spark, sf):
    names = ["Brand#1", "Brand#11", "Brand#2", "Brand#21", "Brand#12"]
    return S.filter_mixture(mixture(spark, sf), names).select("name", r(F.col("weight")).alias("weight"))


@query("smp13_mixture_summary", "SMP-13",
       f"WITH {MIX} SELECT name, {R('weight / sum(weight) OVER ()')} AS weight, items FROM m")
def _(spark, sf):
    m = mixture(spark, sf)
    out = S.mixture_summary(m.drop("items"), m.select("name", "items"))
    return out.select("name", r(F.col("weight")).alias("weight"), "items")


CUM = """c AS (SELECT name, items, sum(weight) OVER (ORDER BY name) / sum(weight) OVER () AS upto,
    (sum(weight) OVER (ORDER BY name) - weight) / sum(weight) OVER () AS fromw FROM m)"""


@query(
    "smp02_weighted_draws",
    "SMP-02 SMP-05",
    f"""WITH {MIX}, {CUM}, d AS (SELECT o_orderkey AS draw, {u_sql("11", "o_orderkey", "'source'")} AS u,
        {u_sql("11", "o_orderkey", "'item'")} AS v FROM orders)
    SELECT draw, name, floor(v * items)::BIGINT AS item FROM d JOIN c ON u < upto AND u >= fromw""",
)
def _(spark, sf):
    slots = table(spark, sf, "orders").select(F.col("o_orderkey").alias("draw"))
    return S.draw_items(slots, mixture(spark, sf), "draw", 11).select("draw", "name", "item")


@query(
    "smp03_dataset_weights",
    "SMP-03",
    f"""WITH {MIX}, w AS (SELECT name, items, CASE WHEN name LIKE '%1' THEN 0 ELSE weight END * items AS w FROM m),
    f AS (SELECT *, CASE WHEN (SELECT bool_or(w <= 0) FROM w) THEN greatest(w, 1e-8) ELSE w END AS g FROM w)
    SELECT name, {R("g / sum(g) OVER ()", 9)} AS sampling_weight FROM f""",
)
def _(spark, sf):
    m = mixture(spark, sf).withColumn("weight", F.when(F.col("name").like("%1"), 0.0).otherwise(F.col("weight")))
    out = S.dataset_weights(m, balance=True, length="items")
    return out.select("name", r(F.col("sampling_weight"), 9).alias("sampling_weight"))


EPI = "e AS (SELECT o.o_custkey % 8 AS dataset, l_orderkey AS episode, count(*) AS n FROM lineitem JOIN orders o ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def episodes(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("episode")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("episode"), (F.col("o_custkey") % 8).alias("dataset"))
    return n.join(o, "episode").select("dataset", "episode", "n")


@query("smp04_trajectory_weights", "SMP-04",
       f"WITH {EPI} SELECT dataset, episode, {R('n / sum(n) OVER (PARTITION BY dataset)', 9)} AS w FROM e")
def _(spark, sf):
    out = S.trajectory_weights(episodes(spark, sf), "dataset", "n")
    return out.select("dataset", "episode", r(F.col("trajectory_weight"), 9).alias("w"))


@query(
    "smp05_draw_steps",
    "SMP-05 SMP-04",
    f"""WITH {EPI}, g AS (SELECT *, sum(n) OVER (PARTITION BY dataset ORDER BY episode) - n AS st,
        sum(n) OVER (PARTITION BY dataset) AS total FROM e),
    t AS (SELECT DISTINCT dataset, total FROM g),
    p AS (SELECT c_custkey AS slot, t.dataset, floor({u_sql("21", "c_custkey", "'step'")} * total)::BIGINT AS at_
      FROM customer JOIN t ON t.dataset = c_custkey % 8)
    SELECT slot, p.dataset, episode, (at_ - st)::BIGINT AS step FROM p JOIN g ON g.dataset = p.dataset AND at_ >= st AND at_ < st + n""",
)
def _(spark, sf):
    slots = table(spark, sf, "customer").select(F.col("c_custkey").alias("slot"), (F.col("c_custkey") % 8).alias("dataset"))
    out = S.draw_steps(slots, episodes(spark, sf), "slot", "dataset", "episode", "n", 21)
    return out.select("slot", "dataset", "episode", "step")


@query(
    "smp06_epoch_length",
    "SMP-06",
    f"""WITH {MIX}, w AS (SELECT items, weight / sum(weight) OVER () AS sw, weight = max(weight) OVER () AS p,
        bool_or(weight = 1) OVER () AS one, weight FROM m)
    SELECT floor(max(items / sw) FILTER (CASE WHEN one THEN weight = 1 ELSE p END))::BIGINT AS epoch_length FROM w""",
)
def _(spark, sf):
    m = S.primary_datasets(S.dataset_weights(mixture(spark, sf), length="items"))
    return S.epoch_length(m, length="items")


TASKS = {"policy": 0.4, "forward_dynamics": 0.3, "inverse_dynamics": 0.2, "video_gen": 0.1}


@query(
    "smp07_task_batches",
    "SMP-07",
    f"""WITH b AS (SELECT DISTINCT o_orderkey // 16 AS batch FROM orders),
    s AS (SELECT batch, i AS slot, {u_sql("9", "0", "0", "batch", "i")} AS u FROM b CROSS JOIN (SELECT unnest(range(16))::INTEGER AS i)),
    t AS (SELECT batch, slot, CASE WHEN slot = 0 OR (slot > 3 AND u < 0.4) THEN 'policy'
        WHEN slot = 1 OR (slot > 3 AND u < 0.4 + 0.3) THEN 'forward_dynamics'
        WHEN slot = 2 OR (slot > 3 AND u < 0.4 + 0.3 + 0.2) THEN 'inverse_dynamics' ELSE 'video_gen' END AS task FROM s)
    SELECT batch, (row_number() OVER (PARTITION BY batch ORDER BY {u_sql("9", "0", "0", "batch", "slot", "'order'")}, slot) - 1)::INTEGER AS position,
      task, (row_number() OVER (PARTITION BY task ORDER BY batch, slot) - 1) AS index FROM t""",
)
def _(spark, sf):
    b = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 16).alias("batch")).distinct()
    return S.task_batches_for(b, 16, TASKS, seed=9)


@query(
    "smp08_sampling_rate",
    "SMP-08",
    f"""WITH d AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {u_sql("4", "lang", "doc_id")}, doc_id) AS rn,
        count(*) OVER (PARTITION BY lang) AS n FROM documents),
    k AS (SELECT *, CASE lang WHEN 'en' THEN 0.25 WHEN 'fr' THEN 0.5 WHEN 'de' THEN 0.07 ELSE 1.0 END AS rate FROM d)
    SELECT doc_id, lang FROM k WHERE rn <= floor(round(rate * n, 6))""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    spec = F.concat("lang", F.when(F.col("lang") == "en", "%25").when(F.col("lang") == "fr", "%50")
                    .when(F.col("lang") == "de", "%07").otherwise(""))
    name, rate = S.parse_rate(spec)
    rates = docs.select("lang").distinct().select(name.alias("lang"), rate.alias("rate"))
    return S.sample_rate(docs, "lang", "doc_id", rates, 4)


@query("smp09_hold_out", "SMP-09",
       f"SELECT o_orderkey FROM orders ORDER BY {u_sql('42', 'o_orderkey')}, o_orderkey LIMIT 1000")
def _(spark, sf):
    return S.hold_out(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000, 42)


@query(
    "smp09_hold_out_with_replacement",
    "SMP-09",
    f"""WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
    d AS (SELECT range AS draw FROM range(5000))
    SELECT draw, c_custkey FROM d JOIN s ON i = floor({u_sql("42", "draw")} * n)::BIGINT""",
)
def _(spark, sf):
    cust = table(spark, sf, "customer").select("c_custkey")
    s = global_index(cust, ["c_custkey"], "i")
    return S.hold_out_with_replacement(s, "i", 5000, 42).select("draw", "c_custkey")


@query(
    "smp10_round_robin",
    "SMP-10",
    """WITH s AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, ((i % greatest((n - 2 + 5) // 6, 1)) * 6 + 2)::BIGINT AS wrapped FROM s WHERE i % 6 = 2""",
)
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    s = global_index(o, ["o_orderkey"], "i")
    n = o.agg(F.count(F.lit(1)).alias("n")).scalar()
    mine = S.round_robin(s, "i", 2, 6)
    return mine.select("o_orderkey", S.step_for_draw(F.col("i"), F.lit(2), F.lit(6), n).alias("wrapped"))


@query(
    "smp11_window_starts",
    "SMP-11",
    f"""WITH n AS (SELECT user_id AS episode, count(*) AS n FROM events GROUP BY 1),
    s AS (SELECT episode, unnest(range(0, n - 17 + 1)) AS start FROM n WHERE n >= 17),
    k AS (SELECT *, row_number() OVER (PARTITION BY episode ORDER BY {u_sql("1234", "episode", "start")}, start) AS rn FROM s)
    SELECT episode, start FROM k WHERE rn <= 8""",
)
def _(spark, sf):
    from epispark.operators.stats import sample_window_starts

    n = table(spark, sf, "events").groupBy(F.col("user_id").alias("episode")).agg(F.count(F.lit(1)).alias("n"))
    return sample_window_starts(n, ["episode"], "n", 17, 8, 1234)


@query(
    "smp12_per_tag_sample",
    "SMP-12",
    f"""WITH k AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {u_sql("6", "source", "doc_id")}, doc_id) AS rn FROM documents)
    SELECT source, doc_id FROM k WHERE rn <= 5""",
)
def _(spark, sf):
    return S.per_tag_sample(table(spark, sf, "documents").select("source", "doc_id"), "source", "doc_id", 5, 6)


@query(
    "agg27_distinct_first",
    "AGG-27",
    "SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY 1, 2",
)
def _(spark, sf):
    from epispark.sources.readers import distinct_first

    return distinct_first(table(spark, sf, "documents").select("source", "lang", "doc_id"), ["source", "lang"], "doc_id")
