"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import collections
import random
import re
import zlib

from epispark.llm import spelling
from epispark.llm.spelling import spelling_variants
from epispark.session import materialise

LETTERS = "abcdefghijklmnopqrstuvwxyzéßÀ×÷"


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least=5, drop=199) -> set[tuple]:
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if drop and h % drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if c >= least and len(w) >= 6}
    form, out = {}, {}
    for w, c in n.items():
        near = sorted((-d, v) for v, d in n.items() if one_edit(w, v))
        form[w] = near[0][1] if near and -near[0][0] >= 5 * c else None
        out[w] = len(near)
    rows = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], out[w], n[form[w]] if form[w] else None))
    return rows


def misspelt(seed=1) -> list[tuple]:
    rng = random.Random(seed)
    base = ["".join(rng.choices(LETTERS, k=rng.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "x" * 400]
    out = []
    for word in base:
        out += [word] * rng.choice((5, 30, 160))
        for _ in range(8):
            way = word
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(way))
                way = way[:i] + rng.choice(("", rng.choice(LETTERS), way[i] + rng.choice(LETTERS))) + way[i + 1 :]
                out += [way.upper() if rng.random() < 0.2 else way] * rng.choice((1, 5, 6))
    out += ["receive"] * 400 + ["recieve", "recieved"] + ["receivex"] * 60 + ["receivexy"] * 8  # a way of two steps
    rng.shuffle(out)
    texts = [(k, " ".join(out[k::50])) for k in range(50)]
    return [*texts, texts[3], (None, out[0]), (60, None), (61, ""), (62, "1 2 3")]


def result(df) -> set[tuple]:
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r.word for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def test_against_brute_force(spark):
    rows = misspelt()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert result(spelling_variants(docs)) == want
    assert any(r[1] and r[1] != r[2] for r in want), "no way of two steps"
    assert result(spelling_variants(docs, symbols=2, drop_every=0)) == brute(rows, drop=0)


def test_odd_rows(odd_docs, no_docs, texts):
    assert result(spelling_variants(odd_docs)) == brute(texts)
    assert spelling_variants(no_docs).count() == 0


def test_nothing_is_broadcast(spark, monkeypatch):
    """Exploded neighbourhoods look as small as their source, and the vocabulary grows with the documents."""
    plans = []

    def noted(df, label):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return materialise(df, label)

    monkeypatch.setattr(spelling, "materialise", noted)
    rows = spelling_variants(spark.createDataFrame(misspelt(), "doc_id long, text string"))
    plans.append(rows._jdf.queryExecution().sparkPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4
    assert not any("Broadcast" in p for p in plans)
