"""Near-duplicates at similarity 0.8 by SimHash variants, against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from epispark.llm import linking
from epispark.llm import shingle_simhash as ss
from epispark.session import scratch_table
from tests.llm.test_minhash import brute, shingle_set


def planted(seed: int = 3, groups: int = 150):
    """Texts with one edited copy each, about 0.8 to 1 similar in 5-word shingles."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(6000)]
    rows, k = [], itertools.count()
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice((60, 150, 400, 900)))
        copy = list(base)
        if rng.random() < 0.5:  # words replaced here and there
            for i in rng.sample(range(len(base)), max(1, int(rng.choice((0.004, 0.01, 0.02)) * len(base)))):
                copy[i] = rng.choice(words)
        else:  # a passage more at one end
            copy += rng.choices(words, k=int(rng.choice((0.02, 0.1, 0.2)) * len(base)))
        rows += [(next(k), " ".join(base)), (next(k), " ".join(copy))]
    rows += [(next(k), " ".join(rng.choices(words, k=300))) for _ in range(100)]
    return rows


def test_recall_and_no_false_link(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in ss.keep_first_similar(docs).collect()}
    root = brute({k: shingle_set(t, 5) for k, t in rows})
    right = {k for k, r in root.items() if k == r}
    similar = len(rows) - len(right)
    missed = len(kept - right)
    assert similar > 100 and right <= kept
    assert missed <= 0.05 * similar


def test_one_large_family(spark):
    rng = random.Random(9)
    base = [f"term{i}" for i in range(200)]
    rows = [(k, " ".join(f"x{rng.random()}" if rng.random() < 0.012 else w for w in base)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = brute({k: shingle_set(t, 5) for k, t in rows})
    assert {r.doc_id for r in ss.keep_first_similar(docs).collect()} == {k for k, r in root.items() if k == r}


def family(many: int):
    """Near copies of one text, part of them similar only by way of others."""
    rng = random.Random(many)
    base = [f"term{i}" for i in range(200)]
    return [(k, " ".join(f"x{rng.random()}" if rng.random() < 0.02 else w for w in base)) for k in range(many)]


def test_rows_joined_with_hubs_follow_the_family(spark, monkeypatch):
    """Each row of a group meets a hub once, so a family twice as large joins twice the rows."""

    def joined(many: int) -> tuple[int, int]:
        rows = {}

        def counted(df, label):
            out = scratch_table(df, label)
            if label in ("different-groups", "open-members", "tile-rows"):
                rows[label] = rows.get(label, 0) + out[0].count()
            return out

        monkeypatch.setattr(linking, "scratch_table", counted)
        monkeypatch.setattr(linking, "materialise", lambda df, label: counted(df, label)[0])
        texts = family(many)
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        kept = {r.doc_id for r in ss.keep_first_similar(docs).collect()}
        assert kept == {k for k, r in brute({k: shingle_set(t, 5) for k, t in texts}).items() if k == r}
        return rows["different-groups"], rows.get("open-members", 0) + rows.get("tile-rows", 0)

    (members, one), (more, two) = joined(150), joined(300)
    assert one <= members and two <= more
    assert more < 2.6 * members and more <= 300 * ss.SEGMENTS * (ss.WEAK + 1)


def test_first_pairs_are_few_and_share_a_group(spark):
    rng = np.random.default_rng(4)
    rows = [(int(g), int(c)) for g, c in {(g, c) for g, c in zip(rng.integers(0, 60, 900), rng.integers(0, 100, 900))}]
    low = {g: min(c for h, c in rows if h == g) for g, _ in rows}
    groups = spark.createDataFrame([(g, c, low[g]) for g, c in rows], "key long, cid long, hub long")
    pairs = [(r.a, r.b) for r in ss.first_pairs(groups).collect()]
    assert len(pairs) == len(set(pairs)) and max(Counter(b for _, b in pairs).values()) <= 3
    assert {b for _, b in pairs} == {c for g, c in rows if c != low[g]}
    assert set(pairs) <= {(low[g], c) for g, c in rows if c != low[g]}


def test_hub_is_the_smallest_near_row_of_a_group(spark):
    bits = {10: (1, 0), 11: (1, 1), 12: (1, 3), 3: (1, -1), 20: (2, 0), 21: (2, 1)}  # 3 shares a key but is far
    rows = [(key, cid, low, low) for cid, (key, low) in bits.items()]
    got = ss.candidate_groups(spark.createDataFrame(rows, "key long, cid long, low long, high long")).collect()
    assert {(r.key, r.cid, r.hub) for r in got} == {(1, 10, 10), (1, 11, 10), (1, 12, 10), (2, 20, 20), (2, 21, 20)}


@pytest.mark.parametrize("large", [8, 40, 8192])
def test_large_groups_are_cut_without_loss(spark, large):
    rng = np.random.default_rng(1)
    low = np.r_[rng.integers(-(1 << 62), 1 << 62, 150), np.full(30, 77)]
    low[150:] ^= 1 << np.arange(30)
    key = np.r_[rng.integers(0, 5, 150), np.repeat([1, 2], 15)]
    high = np.roll(low, 1)
    high[150:] = 5
    rows = [(int(a), i, int(b), int(c)) for i, (a, b, c) in enumerate(zip(key, low, high))]
    ss_rows = spark.createDataFrame(rows, "key long, cid long, low long, high long").repartition(3)
    bits = lambda x, y: ((x ^ y) % (1 << 64)).bit_count()
    differ = lambda x, y: bits(x[2], y[2]) + bits(x[3], y[3])
    want = {a[1] for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and differ(a, b) <= ss.CHECK}
    assert {r.cid for r in ss.candidate_groups(ss_rows, large).collect()} == want


def test_odd_rows(odd_docs, no_docs, texts):
    got = ss.keep_first_similar(odd_docs)
    assert got.columns == odd_docs.columns
    kept = [r.doc_id for r in got.collect()]
    root = brute({i: shingle_set(t, 5) for i, (_, t) in enumerate(texts)})
    worded = {root[i] for i, (_, t) in enumerate(texts) if (t or "").split()}
    assert len(kept) == len(worded) + 1 and len(set(kept)) == len(kept)
    assert {1, 8, 13, 5} <= set(kept) and not {2, 3, 6, 7} & set(kept)
    assert ss.keep_first_similar(no_docs).count() == 0


def test_margins_equal_a_count_of_bits():
    h = np.random.default_rng(2).integers(0, 1 << 63, 700, np.int64).astype(np.uint64)
    assert len(ss.margins(h)) == 64 * ss.LANES and np.abs(ss.margins(h)).max() < 200
    assert (ss.margins(h[:1]) ** 2 == 1).all() and (ss.margins(h[:0]) == 0).all()
    assert (ss.margins(h) == sum(ss.margins(h[i : i + 1]) for i in range(700))).all()


def test_kept_rows_are_never_broadcast(spark):
    """A row per kept document: the plan is the same for few documents as for many."""
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words")], "doc_id long, text string")
    out = ss.keep_first_similar(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]
