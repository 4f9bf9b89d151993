"""Exact similarity components of candidate groups, without listing the pairs of a group.

Candidates come as groups of members that may be similar. Each round one member of every open group is
its hub, and the others are held against it: a star, as many pairs as members. Confirmed links join
components, and a group whose members are all in one component is closed. What is open after a few
rounds is compared tile by tile inside tasks, so no pair that shares a group stays unchecked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.components import components
from epispark.session import materialise, scratch_table

STAR_ROUNDS = 2
TILE = 1024  # members of a slot; a task compares two slots at a time
VOLUME = 1 << 20  # shingles of a slot, 8 MB: slots of long texts have fewer members
COLUMNS = 4096  # shared shingles that a task's incidence matrix holds at once


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can have a similarity of ``percent`` / 100."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets (``cid, n, shingles``) have the similarity."""
    pairs = materialise(pairs, "star-pairs")  # written, so that a hub's pairs can be split
    one = sets.select(F.col("cid").alias("ca"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("cid").alias("cb"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(one, F.col("a") == F.col("ca")).join(two, F.col("b") == F.col("cb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = both.withColumn("shared", shared)
    return both.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def tile_links(sets: list[np.ndarray], comp: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of sets with the similarity, enough to join all components that such pairs join.

    The members of the largest component are held against the others only, as they need no link.
    """
    m = len(sets)
    names, comp, many = np.unique(comp, return_inverse=True, return_counts=True)
    order = np.argsort(comp != many.argmax(), kind="stable")
    g, sets, comp = int(many.max()), [sets[i] for i in order], comp[order]
    if g == m:
        return order[:0], order[:0]
    size = np.fromiter(map(len, sets), np.int64, m)
    flat, who = np.concatenate(sets), np.repeat(np.arange(m), size)
    by = np.argsort(flat, kind="stable")
    flat, who = flat[by], who[by]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    held = np.diff(np.r_[first, len(flat)])
    use = (held > 1) & (np.maximum.reduceat(who, first) >= g)  # shared, and by one outside the largest component
    column = np.repeat(np.cumsum(use) - 1, held)
    on = np.repeat(use, held)
    column, who = column[on], who[on]
    shared = np.zeros((m, m - g), np.float32)
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + COLUMNS + 1, COLUMNS))
    for lo, hi in zip(cuts, cuts[1:]):
        if hi > lo:
            block = np.zeros((m, COLUMNS), np.float32)
            block[who[lo:hi], column[lo:hi] % COLUMNS] = 1
            shared += block @ block[g:].T
    a, b = [], []
    for j in range(m - g):
        both = shared[:, j]
        close = np.flatnonzero((100 * both >= percent * (size + size[g + j] - both)) & (comp != comp[g + j]))
        if len(close):  # one link to each component, which are one from now on
            joined, at = np.unique(comp[close], return_index=True)
            a.append(close[at])
            b.append(np.full(len(at), g + j))
            comp[np.isin(comp, joined)] = comp[g + j]
    a, b = (order[np.concatenate(x)] if x else order[:0] for x in (a, b))
    return a, b


def _tiles(percent: int):
    """Rows (grp, cid, comp, shingles) sorted by grp to links (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(cid, comp, sets):
            a, b = tile_links(sets, np.array(comp), percent)
            cid = np.array(cid, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cid[a]), pa.array(cid[b])], names=["a", "b"])

        held, cid, comp, sets = None, [], [], []
        for batch in batches:
            values = batch.column(3)
            for i, (g, c, k) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)))):
                if g != held:
                    if len(cid) > 1:
                        yield answer(cid, comp, sets)
                    held, cid, comp, sets = g, [], [], []
                cid.append(c)
                comp.append(k)
                sets.append(values[i].values.to_numpy(zero_copy_only=False))
        if len(cid) > 1:
            yield answer(cid, comp, sets)

    return run


def _slots(many: Column, volume: Column, tile: int) -> Column:
    """Number of slots of so many members, with so many shingles."""
    return F.greatest(F.ceil(many / tile), F.ceil(F.coalesce(volume, F.lit(0)) / VOLUME)).cast("int")


def _all_pairs(open_: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links between all members of each group ``key`` (``key, cid, comp, n, own``) that its tiles find.
    ``g, h``, the slots of members with ``own`` and of the others, are counted if they are not given.

    Members with ``own`` are in the hub's component and need no link among themselves: their slots meet
    those of the others only, which meet all slots. A group of two slots is one tile and goes out once, so
    rows grow with the square of the others, and with the group itself while they are one slot.
    """
    slots = open_
    if "g" not in open_.columns:
        own = F.col("own")
        count = [_slots(F.count_if(x), F.sum(F.when(x, F.col("n"))), tile).alias(c) for x, c in ((own, "g"), (~own, "h"))]
        slots = open_.join(open_.groupBy(F.col("key").alias("k")).agg(*count), F.col("key") == F.col("k"))
    one = F.col("g") + F.col("h") < 3
    at = F.when(F.col("own"), F.pmod(F.xxhash64("cid"), "g")).otherwise(F.col("g") + F.pmod(F.xxhash64("cid"), "h"))
    slots = slots.withColumn("s", F.when(one, 0).otherwise(at))
    met = F.sequence(F.when(F.col("own"), F.col("g")).otherwise(0), F.col("g") + F.col("h") - 1)
    slots = slots.withColumn("t", F.explode(F.when(one, F.array(F.lit(0))).otherwise(F.array_remove(met, F.col("s").cast("int")))))
    grp = F.xxhash64("key", F.least("s", "t"), F.greatest("s", "t"))
    dealt = materialise(slots.select(grp.alias("grp"), "cid", "comp"), "tile-rows")
    full = dealt.join(sets.select(F.col("cid").alias("c_"), "shingles"), F.col("cid") == F.col("c_"))
    full = full.select("grp", "cid", "comp", "shingles").repartition("grp").sortWithinPartitions("grp")
    return full.mapInArrow(_tiles(percent), "a long, b long")


def different_groups(members: DataFrame) -> DataFrame:
    """``key, cid, n`` of ``members``, of all groups with the same members one."""
    same = [F.count(F.lit(1)), F.sum(F.xxhash64("cid").cast("decimal(20,0)")), F.bit_xor(F.xxhash64(F.lit(1), "cid"))]
    groups = members.groupBy(F.col("key").alias("k")).agg(*[x.alias(f"s{i}") for i, x in enumerate(same)])
    first = materialise(groups.groupBy("s0", "s1", "s2").agg(F.min("k").alias("k")).select("k"), "groups")
    return materialise(members.join(first, F.col("key") == F.col("k"), "left_semi"), "different-groups")


def _hubs(state: DataFrame, order: Column, tile: int) -> DataFrame:
    """``k, hub, g, h`` of every open group of ``state`` (``key, cid, n, comp, deg``): its hub (``cid, comp, n``), and
    the slots of the hub's component and of the others."""
    hub = F.min(F.struct((-F.col("deg")).alias("d"), order.alias("o"), "cid", "comp", "n")).alias("hub")
    parts = state.groupBy("key", "comp").agg(hub, F.count(F.lit(1)).alias("many"), F.sum("n").alias("volume"))
    most = F.min(F.struct("hub", "many", "volume")).alias("first")
    groups = parts.groupBy(F.col("key").alias("k")).agg(most, F.sum("many").alias("all"), F.sum("volume").alias("volume"))
    many, volume = F.col("first.many"), F.col("first.volume")
    return groups.where(F.col("all") > many).select(
        "k", F.struct("first.hub.cid", "first.hub.comp", "first.hub.n").alias("hub"),
        _slots(many, volume, tile).alias("g"), _slots(F.col("all") - many, F.col("volume") - volume, tile).alias("h"),
    )


def similar_components(
    members: DataFrame, sets: DataFrame, percent: int = 80, rounds: int = STAR_ROUNDS, tile: int = TILE, first: DataFrame | None = None
) -> DataFrame:
    """``node, root`` of every class with a link: components of all similar pairs that share a group.

    ``members`` are ``key, cid, n`` (n: set size), ``sets`` are ``cid, n, shingles``, distinct hashes.
    Both are written tables. ``first`` are pairs ``a, b`` to confirm before any round, so that groups which
    they close are never read; any pairs will do. The hub of a group is the member with most confirmed links
    so far, without links the one with the smallest id, so that groups of the same copies share their stars.
    A group has one hub: rows joined with hubs are no more than the members.
    """
    members = different_groups(members)
    links, found, degree = None, None, None
    for turn in range(rounds + 1) if first is None else range(-1, rounds + 1):
        if turn < 0:
            new, drop = confirm(first, sets, percent), None
        else:
            if links is None:
                state = members.withColumn("comp", F.col("cid")).withColumn("deg", F.lit(0))
            else:
                known = materialise(found.join(degree, F.col("node") == F.col("d_"), "left"), "known")
                state = members.join(known, F.col("cid") == F.col("node"), "left")
                state = state.select("key", "cid", "n", F.coalesce("root", "cid").alias("comp"), F.coalesce("deg", F.lit(0)).alias("deg"))
            state, drop = scratch_table(state, "link-state")
            order = F.col("cid") if links is None else F.xxhash64("cid", F.pmod("key", F.lit(4)))
            hubs = materialise(_hubs(state, order, tile), "hubs")
            if hubs.isEmpty():
                drop()
                break
            joined = state.join(hubs, F.col("key") == F.col("k"))
            if turn == rounds:
                own = F.col("comp") == F.col("hub.comp")
                new = _all_pairs(joined.select("key", "cid", "comp", "n", own.alias("own"), "g", "h"), sets, percent, tile)
            else:
                held = materialise(joined.where("cid <> hub.cid").select("key", "cid", "comp", "n", "hub"), "open-members")
                ask = held.where((F.col("comp") != F.col("hub.comp")) & sizes_fit(F.col("n"), F.col("hub.n"), percent))
                ask = ask.select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b")).distinct()
                new = confirm(ask, sets, percent)
                members = held.select("key", "cid", "n")
        new = materialise(new, "links")
        links = new if links is None else links.unionByName(new)
        if drop:
            drop()
        # components so far are stars already, which settle sooner than all links would
        edges = new if found is None else new.unionByName(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        found = materialise(components(edges, "a", "b"), "components")
        ends = links.select(F.explode(F.array("a", "b")).alias("d_"))
        degree = ends.groupBy("d_").agg(F.count(F.lit(1)).alias("deg"))
    if found is None:
        return members.select(F.col("cid").alias("node"), F.col("cid").alias("root")).limit(0)
    return found
