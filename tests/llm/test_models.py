"""Quality classifier and language-model scores: brute-force parts, held-out accuracy, odd rows."""

from __future__ import annotations

import collections
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest

from epispark.llm import language_model as lm
from epispark.llm import quality_model as qm
from epispark.llm.queries import QUERIES, table

SMALL = "/root/testdata/sf0.01"


def remainder(k, mod):
    return zlib.crc32(str(k).encode()) % mod


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    got = QUERIES["op8_quality_model"](spark, SMALL).collect()
    assert len(got) == table(spark, SMALL, "documents").count()
    for r in got:
        assert r.held_out == (remainder(r.doc_id, 5) == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95


def test_columns_equal_numpy_scores(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = qm.fit_on_labels(docs, labels, sample=300)
    stats = qm.statistics(docs).toPandas()
    want = dict(zip(stats.doc_id, model.predict(stats[model.names].to_numpy())))
    for k, s in qm.statistics(docs).select("doc_id", model.score()).collect():
        assert s == pytest.approx(want[k], abs=1e-12)


def test_rules_are_sparse_and_separate():
    r = np.random.default_rng(1)
    x = r.random((4000, 6))
    y = ((x[:, 1] > 0.4) & (x[:, 4] <= 0.7)).astype(float)
    model = qm.fit(x[:3000], y[:3000], list("abcdef"))
    assert np.mean((model.predict(x[3000:]) >= 0.5) == y[3000:]) > 0.97
    assert 0 < len(model.rules) < len(qm.grow_rules(x[:3000], y[:3000]))


def test_classifier_on_odd_rows(spark, odd_docs, no_docs, texts):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 0, 0), (3, 1, None), (12, 0, 1), (11, None, 0), (None, 1, 0), (14, 7, 0), (99, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    for marks in (labels, labels.where("false"), labels.where("quality = 1")):
        got = qm.score_quality(odd_docs, marks).collect()
        assert len(got) == len(texts)
        assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
        kept = qm.keep_good(odd_docs, marks)
        assert kept.columns == odd_docs.columns
        assert kept.count() == sum(r.score >= 0.3 for r in got)
    assert {r.score for r in qm.score_quality(odd_docs, labels.where("false")).collect()} == {0.5}
    assert qm.score_quality(no_docs, labels).count() == 0


def brute_base(texts):
    """Per text, in order: tokens, known tokens and base score; and the training tokens."""
    tokens = [((t or "").encode().lower().split() + [None]) for _, t in texts]
    train = [k is not None and remainder(k, 10) != 0 for k, _ in texts]
    c = collections.Counter()
    for w, t in zip(tokens, train):
        if t:
            c.update(w)
    n, v = sum(c.values()), len(c)
    out = []
    for w in tokens:
        out.append((len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)))
    return out, n


def check_base(rows, texts):
    want, n = brute_base(texts)
    key = lambda x: (str(x[0]), round(x[3], 5))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in rows), key=key)
    want = sorted(((k, *w) for (k, _), w in zip(texts, want)), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9)
    assert {r.train_tokens for r in rows} == {n}


@pytest.mark.parametrize("head", [lm.HEAD, 40])
def test_scores_of_the_table(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    texts = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    rows = QUERIES["op10_language_model"](spark, SMALL).collect()
    check_base(rows, texts)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (remainder(r.doc_id, 10) == 0) for r in rows)
    tokens = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / tokens > sum(r.base_score for r in held) / tokens
    for r in rows:
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes)


def test_scores_of_odd_rows(spark, odd_docs, no_docs, texts):
    check_base(lm.score_texts(odd_docs).collect(), texts)
    assert lm.score_texts(no_docs).count() == 0
    alone = odd_docs.where("doc_id IS NULL")
    check_base(lm.score_texts(alone).collect(), [x for x in texts if x[0] is None])


def test_next_token_probabilities_sum_to_one():
    """Over all coded words, and the rest symbol split by smoothed counts, mass is one."""
    words = [b"w%d" % i for i in range(30)]
    counts = np.arange(40, 10, -1).astype(np.int64)
    r = np.random.default_rng(2)
    model = lm.Model(words, counts, 5, int(counts.sum()) + 5 + 7, 31 + 4, 4,
                     r.integers(0, 50, (lm.CONTEXTS, 1 << lm.SLOT_BITS, 2)).astype(float),
                     r.normal(0.4, 0.2, (lm.GATES, lm.CONTEXTS + 1)))
    old, lm.CODED = lm.CODED, 12
    try:
        model.prepare()
    finally:
        lm.CODED = old
    before = [b"w1", b"w3", b"w25"]
    ids = [model.ids[w] for w in before]
    total = 0.0
    costs = {}
    for s in range(model.coded + 1):  # the last stands for the rest symbol
        row = np.array([*ids, s if s < model.coded else -1], np.int32)
        both, _, _ = lm._mix(model, row, np.array([4]), model.weights, False)
        part, _, _ = lm._mix(model, row[:3], np.array([3]), model.weights, False)
        costs[s] = both[0] - part[0]
        total += math.exp(costs[s])
    assert total == pytest.approx(1, abs=1e-4)
    # rest: head words beyond the coded ones, 4 known beyond the head with 7 occurrences, unknown words
    all_counts = np.r_[5, counts]
    rest = [*all_counts[model.coded :], 3, 2, 1, 1, 0]
    assert sum(10 ** (math.log10(c + 0.1) - model.rest_norm) for c in rest) == pytest.approx(1)


def test_model_grows_with_the_corpus():
    """Coded words and context slots follow the corpus; a small one has 4,096 coded words."""
    assert lm.coded_words(1000) == 4096 and lm.slot_bits(4096) == 18
    assert lm.coded_words(10**8) == 10**4 and lm.slot_bits(10**4) == 20
    words = [b"w%d" % i for i in range(12_000)]
    counts = np.full(len(words), 10_000, np.int64)
    model = lm.Model(words, counts, 5, int(counts.sum()) + 5, len(words) + 1, 0)
    model.prepare()
    assert model.coded == math.isqrt(model.tokens) > 10_000 and model.slot_bits == 20


def test_tables_equal_their_counts(spark):
    """Tables summed by Spark, of several chunks, equal those counted in one task."""
    rows = [(r.text.encode(), i % 10) for i, r in enumerate(table(spark, SMALL, "documents").limit(60).collect())]
    model, _ = lm.train(spark.createDataFrame(rows, "data binary, part int").repartition(5))
    model.prepare()
    sums = np.zeros((lm.CONTEXTS, 1 << model.slot_bits, 2))
    for _, ids, sizes, _ in lm._token_blocks([t for t, p in rows if p != lm.TUNING_FOLD], model, strange=False):
        symbol, *seeds = lm._contexts(ids, sizes, model)
        node, bit, n = lm._bits(model, symbol)
        for k, slot in enumerate(lm._slots(node, n, seeds, model.slot_bits)):
            np.add.at(sums[k], (slot, bit), 1)
    stretch, sure = lm._read(sums[:, :, 0], sums[:, :, 1])
    assert np.array_equal(model.sure, sure) and np.allclose(model.stretch, stretch)


def test_short_texts_are_refined(monkeypatch):
    """A text of 100 tokens has weights of its own before its end."""
    words = [b"w%d" % i for i in range(30)]
    r = np.random.default_rng(3)
    model = lm.Model(words, np.arange(40, 10, -1).astype(np.int64), 5, 900, 31, 0,
                     r.integers(0, 50, (lm.CONTEXTS, 1 << lm.SLOT_BITS, 2)).astype(float),
                     r.normal(0.4, 0.2, (lm.GATES, lm.CONTEXTS + 1)))
    model.prepare()
    ids = r.integers(1, 30, 100).astype(np.int32)
    own, _, _ = lm._mix(model, ids, np.array([100]), model.weights, False)
    monkeypatch.setattr(lm, "PRIOR", 1e18)
    common, _, _ = lm._mix(model, ids, np.array([100]), model.weights, False)
    assert abs(own[0] - common[0]) > 1e-3


def test_sample_bound_holds_for_repeated_keys(spark, monkeypatch):
    rows = [(k % 12, f"text {k} of a key that many rows share, in words {k * 7}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)] + [(3, 1)] * 5, "doc_id long, quality int")
    seen = []
    fit = qm.fit
    monkeypatch.setattr(qm, "fit", lambda x, y, names: seen.append(len(x)) or fit(x, y, names))
    qm.fit_on_labels(docs, labels, sample=6)
    qm.fit_on_labels(docs, labels)
    assert seen[0] <= 6 and seen[1] <= 12


def test_statistics_count_characters(spark):
    rng = random.Random(3)
    some = "ab XYZ\t\n\x0b\x0c\r|!#*$%&<>@^~.,;:?09ÄÖßé日😀𝐀ǅ\x1c\x85　\\-[]"
    texts = ["", " ", "\n \n", "\x0b"] + ["".join(rng.choices(some, k=rng.randint(1, 60))) for _ in range(300)]
    rows = qm.statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        words = max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t)))
        count = lambda chars: sum(c in chars for c in t)
        assert r.word_length == (len(t) - count(" \t\n")) / words
        assert [r.symbols, r.bars] == [count("#*$%&<>@^~") / words, count("|") / words]
        assert [r.shouts, r.stops] == [count("!") / words, count(".,;:?") / words]
        assert r.digits == count("0123456789") / max(1, len(t))
        assert r.upper == sum(unicodedata.category(c) == "Lu" for c in t) / max(1, len(t))


def test_score_has_generated_code_of_its_own(spark, odd_docs):
    """Texts are not translated character by character, and the long score is not in one method with the statistics."""
    rules = [qm.Rule(((i, True, 0.5),)) for i in range(len(qm.FEATURES))]
    score = qm.RuleModel(list(qm.FEATURES), 0.1, rules, [0.1] * len(rules)).score()
    plan = qm.statistics(odd_docs).select("doc_id", score)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" in plan and "translate(" not in plan
    stages = [(line.split(")")[0], line) for line in plan.split("\n") if line.strip(" +-:").startswith("*(")]
    counts = {s.strip(" +-:") for s, line in stages if "regexp_replace" in line}
    scores = {s.strip(" +-:") for s, line in stages if "EXP(" in line}
    assert len(scores) == 1 and not scores & counts
