"""Quality rules and source mixing: SQL oracles, odd rows, properties."""

from __future__ import annotations

import collections
import re

import pytest
from pyspark.sql import functions as F

from epispark.llm import quality_rules as qr
from epispark.llm.mixing import SCHEDULES, draw, integral, invert, mix
from epispark.llm.queries import ORACLES, QUERIES
from epispark.llm.words import word_count
from epispark.session import materialise
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) == ""


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_measurements_of_odd_rows(odd_docs, no_docs, texts):
    got = collections.Counter(
        (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        for r in qr.filter_quality(odd_docs).collect()
    )
    want = collections.Counter()
    for k, t in texts:
        w, t = words_of(t), t or ""
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        cover = {i + d for i, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if words_of(x)]
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        want[(k, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"),
              len(lines) - len(set(lines)), len(cover), failed)] += 1
    assert got == want
    assert qr.filter_quality(no_docs).count() == 0


def test_ledger_policies_and_ablations(odd_docs):
    rows = materialise(qr.ledger(odd_docs), "ledger")
    kept = qr.apply_policy(rows, "v1").where("kept").count()
    assert kept == rows.where("failed_bits = 0").count()
    for r in qr.ablations(rows).collect():
        others = [n for n in qr.RULES if n != r.rule]
        assert qr.apply_policy(rows, others).where("kept").count() == kept + r.only_this


def test_mix_of_odd_rows(odd_docs, no_docs, texts):
    out = mix(odd_docs, word_count("text")).collect()
    assert len(out) == len(texts)
    total = sum(r["size"] for r in out)
    by_source = collections.defaultdict(list)
    for r in out:
        by_source[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
        assert (r.position is None) == (r.taken == 0)
        assert all(0 <= p <= 1 for p in r.positions)
    for rows in by_source.values():
        size = sum(r["size"] for r in rows)
        assert {r.source_size for r in rows} == {size}
        assert sum(r.taken for r in rows) == int(rows[0].target)
        assert rows[0].target <= 2 * size
    assert sum(rows[0].target for rows in by_source.values()) == pytest.approx(1.5 * total)
    places = [r.position for r in out if r.position is not None]
    assert places == sorted(places)
    assert mix(no_docs, word_count("text")).count() == 0
    again = mix(odd_docs, word_count("text")).collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in out]


def test_excess_is_reshared(spark):
    rows = [("a", 1)] * 10 + [("b", 10)] * 10 + [("c", 10)] * 100 + [(None, 1)] * 3
    docs = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, n long")
    got = {r.source: r.target for r in mix(docs, F.col("n")).collect()}
    # total 1669.5; a is capped at 20, null at 6, b at 200, the rest goes to c
    assert got == {"a": 20.0, None: 6.0, "b": 200.0, "c": 1443.5}


def test_schedules_integrate_and_invert(spark):
    assert [integral(s) for s in SCHEDULES] == [3, 1, 2]
    knots = ((0.0, 0.0), (0.25, 4.0), (0.5, 1.0), (1.0, 0.0))
    df = spark.range(101).select((F.col("id") / 100).alias("y"))
    for y, t in df.select("y", invert(knots, F.col("y"))).collect():
        done = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            u = min(max((t - t0) / (t1 - t0), 0), 1)
            done += (t1 - t0) * (w0 * u + (w1 - w0) * u * u / 2)
        assert done == pytest.approx(y * integral(knots), abs=1e-9)


def test_draw_keeps_columns_and_repeats(odd_docs):
    docs = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    out = draw(docs, word_count("text"))
    assert out.columns == docs.columns
    plan = {r.doc_id: r for r in mix(docs, word_count("text")).collect()}
    got = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
    for k, r in plan.items():
        assert abs(got[k] * r["size"] - r.taken) <= r["size"] / 2


def test_draw_of_repeated_and_null_keys(spark):
    """Every row is planned and drawn by itself, at most twice, up to its source's target."""
    rows = [(7, f"one two three four r{i}", "a") for i in range(6)] + [(7, "same words here", "a")] * 6
    rows += [(None, f"no key at all n{i}", "b") for i in range(8)] + [(k, "a b c", "b") for k in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = draw(docs, word_count("text")).collect()
    plan = mix(docs, word_count("text")).collect()
    assert sum(len(p.positions) for p in plan) - 2 <= len(out) <= sum(len(p.positions) for p in plan)
    have, got = collections.Counter(rows), collections.Counter(map(tuple, out))
    assert all(n <= 2 * have[x] for x, n in got.items())
    assert any(k is None for k, _, _ in got)
