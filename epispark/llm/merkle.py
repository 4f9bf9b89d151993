"""Merkle manifest of a document table: content-addressed records, proofs by descent from the root.

A record maps a node's digest to its children's digests. Leaf requests go down from the root: the
base-``FAN`` digits of a leaf's rank choose the child at every level, and the other children are the
siblings of the proof. Requests with a common beginning of digits travel as one row, so the rows of a
level are its nodes. Siblings come out from the root down and are reversed at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epispark.session import materialise, scratch_table

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*fields: Column) -> Column:
    """Sha256 of the fields, each ``-`` if null, else its UTF-8 length, ``:`` and its text."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank``, their 0-based place in their group, and ``n``, the group's size.

    Rows are range-partitioned by group, order and a row number that separates equal rows, so neither a
    hot group nor a repeated row fills one task; only counts per partition and group go across.
    """
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "rank-rows")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, group, *order, "row").withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "rank-parts")
    counts = dealt.groupBy(group, "part").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(group)
    counts = counts.select(
        F.col(group).alias("g_"), F.col("part").alias("p_"),
        F.coalesce(F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"),
        F.sum("c").over(w).alias("n"),
    )
    inner = Window.partitionBy(group, "part").orderBy(*order, "row")
    dealt = dealt.withColumn("inside", F.row_number().over(inner) - 1)
    dealt = dealt.join(counts, (F.col(group) == F.col("g_")) & (F.col("part") == F.col("p_")))
    return dealt.withColumn("rank", (F.col("shift") + F.col("inside")).cast("long")).drop(
        "row", "part", "inside", "g_", "p_", "shift"
    )


def build(nodes: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], DataFrame | None]:
    """Records ``digest, children`` level by level, and ``g, digest, height`` of every group's root.

    ``nodes`` are ``g, n, rank, digest``. While a group has more than one node, every ``fan`` consecutive
    ones become one; a run never has more rows than that. Levels are written tables.
    """
    records, tops, height = [], [], 0
    while True:
        tops.append(nodes.where("n = 1").select("g", "digest", F.lit(height).alias("height")))
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            break
        run = F.array_sort(F.collect_list(F.struct("rank", "digest")))
        up = F.floor(F.col("rank") / fan).alias("up")
        level = nodes.groupBy("g", "n", up).agg(F.transform(run, lambda x: x["digest"]).alias("children"))
        level = materialise(level.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), "merkle-level")
        records.append(level.select("digest", "children"))
        nodes = level.select("g", F.ceil(F.col("n") / fan).alias("n"), F.col("up").alias("rank"), "digest")
        height += 1
    out = tops[0]
    for more in tops[1:]:
        out = out.unionByName(more)
    return records, out


def _down(front: DataFrame, records: DataFrame, fan: int) -> DataFrame:
    """One level down: each child with its unselected siblings left and right of it on the path."""
    met = front.join(records.withColumnRenamed("digest", "d_"), F.col("digest") == F.col("d_"))
    met = met.select("*", F.posexplode("children").alias("digit", "child"))
    left = F.array_join(F.slice("children", F.lit(1), F.col("digit")), "")
    right = F.array_join(F.slice("children", F.col("digit") + 2, F.lit(fan)), "")
    side = F.array(F.struct(left.alias("l"), right.alias("r")))
    return met.select(
        *[c for c in front.columns if c not in ("rank", "digest", "height", "path")],
        (F.col("rank") * fan + F.col("digit")).alias("rank"), F.col("child").alias("digest"),
        (F.col("height") - 1).alias("height"), F.concat("path", side).alias("path"),
    )


def _descend(front: DataFrame, records: DataFrame, deepest: int, lowest: int, fan: int) -> DataFrame:
    """Rows of ``front`` brought down to height ``lowest``; rows that start below stay as they are."""
    done, drop = [], None
    for _ in range(deepest - lowest):
        done.append(materialise(front.where(F.col("height") <= lowest), "merkle-done"))
        front, used = scratch_table(_down(front.where(F.col("height") > lowest), records, fan), "merkle-front")
        if drop:
            drop()
        drop = used
    for more in done:
        front = front.unionByName(more)
    return front


class Manifest:
    """The tree over a document table; equal rows have equal leaves and share records.

    ``leaves`` are ``g, rank, n``, the carried columns and ``digest``; ``records`` map digests to
    children; ``tops`` are the groups' subroots with ``rank``; ``root`` is None for an empty table.
    """

    def __init__(self, docs: DataFrame, leaf: Column, group: Column, order: str, carry: Sequence[Column] = (), fan: int = FAN):
        self.fan = fan
        # "" for the null group, "=" and the value for others: the same order, and no nulls as join keys
        g = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
        rows = docs.select(g.alias("g"), F.col(order).alias("order"), leaf.alias("digest"), *carry)
        self.leaves = materialise(ranked(rows, "g", ["order", "digest"]), "merkle-leaves")
        low, tops = build(self.leaves.select("g", "n", "rank", "digest"), fan)
        tops = tops.select(F.lit("").alias("g"), F.col("g").alias("source"), "digest", "height")
        self.tops = materialise(ranked(tops, "g", ["source"]), "merkle-tops")
        high, root = build(self.tops.select("g", "n", "rank", "digest"), fan)
        first = root.select("digest").first()
        self.root = first[0] if first else None
        self.depth, self.top_depth = len(low), len(high)
        store = docs.sparkSession.createDataFrame([], "digest string, children array<string>")
        for level in low + high:
            store = store.unionByName(level)
        # content-addressed: equal nodes are stored once
        self.records = materialise(store.groupBy("digest").agg(F.first("children").alias("children")), "merkle-records")

    def paths(self) -> DataFrame:
        """The leaves with ``subroot`` and ``path``, their siblings ``l, r`` from the leaf to the root."""
        spark = self.records.sparkSession
        start = spark.createDataFrame(
            [(0, self.root, self.top_depth)] if self.root else [], "rank long, digest string, height int"
        ).withColumn("path", F.array().cast("array<struct<l:string,r:string>>"))
        subroots = _descend(start, self.records, self.top_depth, 0, self.fan)
        tops = self.tops.select(F.col("rank").alias("t"), "source", F.col("height").alias("h"))
        front = subroots.join(tops, F.col("rank") == F.col("t")).select(
            "source", F.col("digest").alias("subroot"), F.lit(0).cast("long").alias("rank"), "digest", F.col("h").alias("height"), "path"
        )
        # parents of leaves carry the path once for all their leaves
        last = materialise(_descend(materialise(front, "merkle-front"), self.records, self.depth, 1, self.fan), "merkle-parents")
        parents = last.where("height = 1").join(
            self.records.withColumnRenamed("digest", "d_"), F.col("digest") == F.col("d_")
        ).select("source", "subroot", "rank", "children", "path")
        alone = last.where("height = 0").select("source", "subroot", "rank", F.array("digest").alias("children"), "path")
        parents = materialise(parents.withColumn("deep", F.lit(True)).unionByName(alone.withColumn("deep", F.lit(False))), "merkle-parents")
        parents = parents.withColumnRenamed("rank", "parent")
        leaves = self.leaves.join(
            parents, (F.col("g") == F.col("source")) & (F.floor(F.col("rank") / self.fan) == F.col("parent"))
        )
        digit = F.pmod("rank", F.lit(self.fan)).cast("int")
        left = F.array_join(F.slice("children", F.lit(1), digit), "")
        right = F.array_join(F.slice("children", digit + 2, F.lit(self.fan)), "")
        own = F.when(F.col("deep"), F.array(F.struct(left.alias("l"), right.alias("r")))).otherwise(
            F.array().cast("array<struct<l:string,r:string>>")
        )
        return leaves.withColumn("path", F.reverse(F.concat("path", own))).drop("source", "parent", "children", "deep")


def proof_digest(path: Column) -> Column:
    """Sha256 of all siblings of a path from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), ""), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]), 256))


def verify_manifest(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", fields: Sequence[str] = FIELDS
) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every document.

    Where 2 divides the crc32 of the key, the text is tampered with: its line ends are deleted. Leaves
    are digests of ``fields``; a source's leaves ascend by key.

    Nulls are a field value of their own; a null key comes first in its source, counts as the empty text
    in the crc32, which is 0, and so is tampered with; a null source is a source of its own, first of
    all; ties of the key are ordered by leaf; repeated rows are leaves of their own with equal digests;
    an empty table gives an empty table; other columns are not read.
    """
    columns = {c: F.col(c) for c in fields}
    changed = columns | {text: F.replace(F.col(text), F.lit("\n"), F.lit(""))}
    hit = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 2 == 0
    leaf = leaf_digest(*columns.values())
    shown = F.when(hit, leaf_digest(*changed.values())).otherwise(leaf)
    tree = Manifest(docs, leaf, F.col(source), key, [shown.alias("shown")])
    folded = fold(F.col("path"), F.col("shown"))
    rows = tree.paths().select(
        F.col("order").alias(key), F.col("digest").alias("leaf"), "subroot", F.lit(tree.root).cast("string").alias("root"),
        proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
