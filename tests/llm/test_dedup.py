"""SimHash groups, connected components and suffix dedup against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from epispark.llm import simhash
from epispark.llm.components import components
from epispark.llm.deep_shallow import common_prefix, deep_shallow_sort
from epispark.llm.queries import QUERIES, table
from epispark.llm.suffix_dedup import dedup_digest, reach, remove_repeats

xxhash = pytest.importorskip("xxhash")


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(keys, prints):
    """Smallest key reachable over links of 4 bits or fewer; None sorts last."""
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i] or 0))
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a = np.array([prints[i] for i in order], np.uint64)
    for i in range(len(order)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 4) + i + 1:
            x, y = sorted((find(i), find(int(j))))
            root[y] = x
    return {(keys[n], "%016x" % prints[n], keys[order[find(i)]]) for i, n in enumerate(order)}


def test_near_duplicates_of_odd_rows(odd_docs, no_docs, texts):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(texts)
    assert set(map(tuple, got)) == plain_groups([k for k, _ in texts], [plain_fingerprint(t) for _, t in texts])
    assert simhash.near_duplicates(no_docs).count() == 0
    kept = simhash.keep_first(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in map(tuple, got)}


def test_near_duplicates_of_the_table(spark, sf):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    got = QUERIES["op4_simhash"](spark, sf).collect()
    keys = list(texts)
    assert set(map(tuple, got)) == plain_groups(keys, [plain_fingerprint(texts[k]) for k in keys])


@pytest.mark.parametrize("large", [8192, 40])
def test_links_keep_all_components(spark, large):
    """A dense ball, chains and strangers; with small ``large`` groups go through slots."""
    rnd = random.Random(2)
    prints = [rnd.getrandbits(64) for _ in range(300)]
    ball = rnd.getrandbits(64)
    for _ in range(300):
        f = ball
        for b in rnd.sample(range(64), rnd.randint(0, 3)):
            f ^= 1 << b
        prints.append(f)
    f = rnd.getrandbits(64)
    for _ in range(40):  # each 4 bits from the last: a chain
        for b in rnd.sample(range(64), 4):
            f ^= 1 << b
        prints.append(f)
    prints = list(dict.fromkeys(prints))
    rows = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    edges = simhash.links(spark.createDataFrame(rows, "fp long").repartition(4), large)
    got = components(edges, "a", "b").collect()
    want = {(k, c) for k, _, c in plain_groups(list(range(len(prints))), prints)}
    place = {r[0]: i for i, r in enumerate(rows)}
    lowest = {}
    for r in got:
        lowest[r.root] = min(lowest.get(r.root, 1 << 60), place[r.node])
    mine = {(place[r.node], lowest[r.root]) for r in got}
    linked = {k for k, _ in mine}
    assert mine | {(i, i) for i in range(len(prints)) if i not in linked} == want


def test_components_of_chains_stars_and_nulls(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    rows += [(5000, 5000), (None, 3), (7, None), (2001, 2000), (2000, 2001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "x long, y long"), "x", "y").collect()}
    want = {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)} | {2000: 2000, 2001: 2000}
    assert got == want
    assert components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def test_deep_shallow_sort():
    r = random.Random(3)
    for n in [1, 2, 3, 10, 63, 64, 65, 100, 300] * 8:
        base = "".join(r.choices("ab", k=60))
        s = []
        for _ in range(n):
            x = list(base[: r.randint(0, 60)])
            for _ in range(r.randint(0, 3)):
                if x:
                    x[r.randrange(len(x))] = r.choice("ab\0")
            s.append("".join(x).encode())
        order, lcp = deep_shallow_sort(s)
        ranked = [s[i] for i in order]
        assert sorted(order.tolist()) == list(range(n)) and ranked == sorted(s)
        assert lcp[1:].tolist() == [common_prefix(a, b) for a, b in zip(ranked, ranked[1:])]


def test_reach_in_both_forms(monkeypatch):
    r = random.Random(4)
    side = 12
    texts = ["".join(r.choices("ab", k=2 * side)) for _ in range(20)]
    rows = [list(r.choice(texts)) for _ in range(150)]
    for x in rows:
        x[r.randrange(2 * side)] = r.choice("abc")
    forward = ["".join(x[side : side + r.randint(6, side)]).encode() for x in rows]
    back = ["".join(x[:side][::-1][: r.randint(6, side)]).encode() for x in rows]
    import epispark.llm.suffix_dedup as s

    dense = reach(forward, back, side)
    monkeypatch.setattr(s, "DENSE", 1)
    loops = reach(forward, back, side)
    want_l, want_r = [], []
    for i in range(len(rows)):
        hits = [o for o in range(side + 1) if len(back[i]) >= o and len(forward[i]) >= side - o and any(
            j != i and len(back[j]) >= o and len(forward[j]) >= side - o
            and back[i][:o] == back[j][:o] and forward[i][: side - o] == forward[j][: side - o]
            for j in range(len(rows)))]
        want_l.append(max(hits, default=-1))
        want_r.append(side - min(hits) if hits else -1)
    assert loops[0].tolist() == want_l and loops[1].tolist() == want_r
    # the matrix form takes whole common prefixes, which reach at least as far inside repeats
    assert ((dense[0] >= 0) == (loops[0] >= 0)).all()
    assert (dense[0] >= loops[0]).all() and (dense[1] >= loops[1]).all()


def brute_dedup(texts, length):
    starts = collections.Counter()
    for _, t in texts:
        d = (t or "").encode()
        starts.update(d[i : i + length] for i in range(len(d) - length + 1))
    out = []
    for k, t in texts:
        d = (t or "").encode()
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if starts[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((k, len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_of_odd_rows(odd_docs, no_docs, texts):
    short = [(k, t) for k, t in texts if k != 8]
    got = sorted(map(tuple, dedup_digest(odd_docs.where("doc_id IS NULL OR doc_id <> 8")).collect()), key=str)
    assert got == brute_dedup(short, 400)
    assert dedup_digest(odd_docs).count() == len(texts)
    assert dedup_digest(no_docs).count() == 0
    cut = remove_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == len(texts)


@pytest.mark.parametrize("large", [20_000, 3])
def test_suffix_dedup_of_hard_texts(spark, large):
    """Periods, overlaps, passages with many neighbours, texts longer than a buffer."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcde", k=r.randint(2, 6)))
    passage = " ".join(word() for _ in range(25))
    texts = [" ".join(word() for _ in range(60)) for _ in range(12)]
    texts += [f"{word()} {word()} {passage} {word()} {word()}" for _ in range(14)]
    texts += ["onhe. Is " * 40 + word() for _ in range(5)] + [word() + "a" * 300 for _ in range(4)]
    texts += [t[:150] + "!" + t[150:] for t in texts[:8]] + [texts[0][20:], texts[0][40:] + "é"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, dedup_digest(df, length=60, piece=12, large=large).collect()), key=str)
    assert got == brute_dedup(rows, 60)


def test_suffix_dedup_over_buffer_edges(spark, monkeypatch):
    import epispark.llm.suffix_dedup as s

    monkeypatch.setattr(s, "BUFFER", 97)
    r = random.Random(8)
    texts = ["".join(r.choices("abcdefgh ", k=700)) for _ in range(4)]
    texts += [texts[0][:300] + "#" + texts[1][250:600], "xy " * 200, texts[2]]
    data = [t.encode() for t in texts]
    whole, cut = {}, {}
    cut_rows = [tuple(x) for out in s.Anchors(60, 12).of(data) for x in zip(*[c.tolist() for c in out])]
    monkeypatch.setattr(s, "BUFFER", 1 << 18)
    rows = [tuple(x) for out in s.Anchors(60, 12).of(data) for x in zip(*[c.tolist() for c in out])]
    for found, into in ((cut_rows, cut), (rows, whole)):
        for text, pos, before, after, own, h, ctx, run, many in found:
            assert (text, pos) not in into
            into[(text, pos)] = (before, after, h, ctx) if many == 1 else None
    assert sum(x[-1] for x in cut_rows) == sum(x[-1] for x in rows)
    alone = {k: v for k, v in whole.items() if v}
    assert alone == {k: cut[k] for k in alone}


def test_suffix_dedup_of_the_table(spark, sf):
    texts = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    found = QUERIES["op7_suffix_dedup"](spark, sf).collect()
    assert sorted((tuple(r)[:5] for r in found), key=str) == brute_dedup(texts, 400)
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in texts}
    windows = lambda w: (tuple(w[i : i + 51]) for i in range(len(w) - 50))
    starts = collections.Counter(x for w in split.values() for x in windows(w))
    for r in found:
        gone = {i + j for i, x in enumerate(windows(split[r.doc_id])) if starts[x] > 1 for j in range(51)}
        assert r.passage_words == len(gone)


def test_one_row_of_a_group_stays(spark):
    """Exact repeats, and groups of null keys only, give one row each."""
    base = [" ".join(f"w{g}x{i}" for i in range(80)) for g in range(3)]
    rows = [(1, base[0])] * 5 + [(2, base[0])] + [(None, base[1])] * 4 + [(None, base[2]), (9, base[2])]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, base[0]), (None, base[1]), (9, base[2])], key=str)
