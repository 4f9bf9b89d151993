"""MinHash duplicates and exact similarity components against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from epispark.llm import linking
from epispark.llm.linking import similar_components
from epispark.llm.minhash import minhash_duplicates, signature
from epispark.llm.wordhash import PIECE, shingles, word_hashes


def shingle_set(text, width=2):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(sets: dict) -> dict:
    """Smallest reachable key of every key, linked at 100 * intersection >= 80 * union."""
    root = {k: k for k in sets}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {k: top(k) for k in sets}


def families(seed: int = 5) -> list[tuple[int, str]]:
    """Originals with copies that lie around the limit, exact copies and short texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    out = []
    for _ in range(40):
        base = rng.choices(words, k=rng.choice((6, 30, 200)))
        for share in (0, 0, 0.02, 0.04, 0.05, 0.06, 0.08, 0.1, 0.2):
            out.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
    rng.shuffle(out)
    return list(enumerate([*out, "one", "ONE", "one two", "", None, " \t", "one two three"]))


def test_against_brute_force(spark):
    rows = families()
    got = {r.doc_id: r for r in minhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    sets = {k: shingle_set(t) for k, t in rows}
    want = brute(sets)
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.n_shingles == len(sets[k]) and r.kept == (want[k] == k) for k, r in got.items())


def test_one_large_family(spark):
    """Copies of one text, most of which are linked only through the original."""
    rng = random.Random(9)
    base = [f"term{i}" for i in range(150)]
    rows = [(k, " ".join(f"x{rng.random()}" if rng.random() < 0.05 else w for w in base)) for k in range(300)]
    rows.append((300, " ".join(base)))
    got = minhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute({k: shingle_set(t) for k, t in rows})
    assert {r.doc_id: r.component_id for r in got.collect()} == want


@pytest.mark.parametrize("rounds, tile", [(0, 1000), (0, 3), (1, 7), (4, 128)])
def test_stars_and_tiles_agree(spark, rounds, tile):
    rng = np.random.default_rng(3)
    sets = {}
    for f in range(4):
        base = rng.integers(-(1 << 62), 1 << 62, 60)
        for k in range(12):
            own = np.r_[base[rng.random(60) > 0.06 * (k % 4)], rng.integers(-(1 << 62), 1 << 62, k % 5)]
            sets[100 * f + k] = set(own.tolist())
    table = spark.createDataFrame([(k, len(s), sorted(s)) for k, s in sets.items()], "cid long, n long, shingles array<long>")
    members = spark.createDataFrame([(k % 3 * 1000 + k // 100, k, len(s)) for k, s in sets.items()], "key long, cid long, n long")
    members = members.unionByName(spark.createDataFrame([(77, k, len(s)) for k, s in sets.items()], "key long, cid long, n long"))
    got = {r.node: r.root for r in similar_components(members, table, 80, rounds, tile).collect()}
    want = brute(sets)
    assert {k: got.get(k, k) for k in sets} == want


def test_rows_of_tiles_follow_the_strangers(spark, monkeypatch):
    """Members of the hub's component are not held against one another: doubling them doubles the rows."""

    def sent(many: int) -> int:
        rows = [(1, k, 0 if k >= 40 else k + 1, 3, k >= 40) for k in range(many + 40)]
        open_ = spark.createDataFrame(rows, "key long, cid long, comp long, n long, own boolean")
        sets = spark.createDataFrame([(k, [3 * k, 3 * k + 1, 3 * k + 2]) for k in range(many + 40)], "cid long, shingles array<long>")
        kept = []
        monkeypatch.setattr(linking, "materialise", lambda df, label: kept.append(df.count()) or df)
        assert linking._all_pairs(open_, sets, 80, 32).isEmpty()
        return kept[0]

    one, two = sent(640), sent(1280)
    assert one < 680 * 4 and two < 2.2 * one


def test_equal_groups_are_one(spark):
    rows = [(key, cid, 5) for key, cids in ((1, (1, 2)), (2, (1, 2)), (3, (1, 2, 3)), (4, (2, 1))) for cid in cids]
    got = linking.different_groups(spark.createDataFrame(rows, "key long, cid long, n long"))
    assert sorted(r.key for r in got.select("key").distinct().collect()) == [1, 3]


def test_odd_rows(odd_docs, no_docs, texts):
    got = minhash_duplicates(odd_docs).collect()
    assert len(got) == len(texts)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[1].component_id == by_id[2].component_id == by_id[3].component_id == by_id[4].component_id == 1
    assert all(by_id[k].n_shingles == 0 and by_id[k].component_id == k and by_id[k].kept for k in (5, 6, 7))
    assert sorted(r.component_id or 0 for r in got if r.doc_id is None) == [0, 1]
    assert minhash_duplicates(no_docs).count() == 0


def test_only_null_keys(spark):
    rows = [(None, "a b c"), (None, "a b c"), (None, "d e f")]
    got = minhash_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.component_id, r.kept) for r in got] == [(None, True)] * 3


def test_signature_and_words():
    one = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5).astype(np.uint64))
    assert set(signature(one).tolist()) <= set(one.tolist())
    text = "Ab  cd\t\nab é " * (PIECE // 8) + "z" * (PIECE + 5) + " ab"
    raw = text.encode()
    hashes, starts, ends = word_hashes(raw, lower=True)
    words = raw.lower().split()
    assert [raw[a:b].lower() for a, b in zip(starts, ends)] == words
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))
    assert len(shingles(hashes[:3], 5)) == 1 and not len(shingles(hashes[:0], 2))
