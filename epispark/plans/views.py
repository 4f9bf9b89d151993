"""Views that let the benchmark tables play the roles of the episodic data model.

``*_SQL`` constants are the same views as CTE bodies for the SQL oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.scale import dense_index, key_prefix, order_buckets


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def signal_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Time-series frames from ``events``: one episode per user, dense frame index by time."""
    ev = table(spark, sf, "events").select(
        F.col("user_id").alias("episode"),
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        "value",
        "event_type",
        "props",
    )
    bucket = order_buckets(ev, F.col("us"), keys=["episode"])
    return dense_index(ev, ["episode"], ["us", "event_id"], key_prefix(bucket))


EV = """ev AS (
  SELECT user_id AS episode, event_id, epoch_us(ts) AS us, value, event_type, props,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame
  FROM events)"""


def line_frames(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    """Vector frames from ``lineitem``: one episode per order, four value columns x0..x3."""
    names = {
        "episode": "l_orderkey",
        "ln": "l_linenumber",
        "pk": "l_partkey",
        "sk": "l_suppkey",
        "x0": "l_quantity",
        "x1": "l_extendedprice",
        "x2": "l_discount",
        "x3": "l_tax",
    }
    cols = [F.col(c).cast("double" if a[0] == "x" else "long").alias(a) for a, c in names.items()]
    li = table(spark, sf, "lineitem").select(*cols, *extra)
    prefix = key_prefix(order_buckets(li, F.col("pk"), keys=["episode"]), F.col("ln"))
    return dense_index(li, ["episode"], ["ln", "pk", "sk", "x1"], prefix)


LF = """lf AS (
  SELECT l_orderkey::BIGINT AS episode, l_linenumber::BIGINT AS ln, l_partkey::BIGINT AS pk,
         l_suppkey::BIGINT AS sk,
         l_quantity::DOUBLE AS x0, l_extendedprice::DOUBLE AS x1, l_discount::DOUBLE AS x2,
         l_tax::DOUBLE AS x3, l_returnflag, l_linestatus, l_shipdate,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS frame
  FROM lineitem)"""


def line_vector() -> Column:
    return F.array("x0", "x1", "x2", "x3")


# pose and gripper built from the value columns: metres, radians, [0, 1]
POSE = {
    "px": "x0 / 50",
    "py": "x2 * 10",
    "pz": "x3 * 10",
    "pr": "x0 / 8 - 3",
    "pp": "x2 * 12 - 0.6",
    "pw": "x3 * 60 - 2",
    "grip": "x2 * 12",
}


def pose_frames(spark: SparkSession, sf: str) -> DataFrame:
    return line_frames(spark, sf).select(
        "episode", "frame", *[F.expr(e).alias(n) for n, e in POSE.items()]
    )


PF = (
    LF
    + ",\npf AS (SELECT episode, frame, "
    + ", ".join(f"{e} AS {n}" for n, e in POSE.items())
    + " FROM lf)"
)


def long_values(df: DataFrame, cols: list[str], *keep: str) -> DataFrame:
    """Columns to (keep, dim, value) rows; a narrow expansion, no shuffle."""
    pairs = F.array(
        *[F.struct(F.lit(i).alias("dim"), F.col(c).alias("value")) for i, c in enumerate(cols)]
    )
    return df.select(*keep, F.inline(pairs))


LONG = """lv AS (
  SELECT episode, frame, unnest([0, 1, 2, 3]) AS dim, unnest([x0, x1, x2, x3]) AS value FROM lf)"""
