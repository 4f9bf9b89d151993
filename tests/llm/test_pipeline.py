"""The corpus pipeline: contract, stages against brute force, odd rows."""

from __future__ import annotations

import collections
import re

import pytest

import corpus_pipeline as cp
from epispark.llm import quality_model as qm
from epispark.llm.mixing import mix
from epispark.llm.queries import table, tokenizer_path
from epispark.llm.words import word_count
from epispark.session import materialise
from tests.llm.test_minhash import brute, shingle_set

sentencepiece = pytest.importorskip("sentencepiece")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for _, f in cp.STAGES:
        new = materialise(f(spark, docs, sf), "stage")
        out.append((docs, new))
        docs = new
    return out


def test_contract(stages, spark, sf):
    assert 4 <= len(cp.STAGES) <= 5
    columns = table(spark, sf, "documents").columns
    assert all(new.columns == columns for _, new in stages[:-1])
    want = collections.Counter((r.doc_id, tuple(r.ids)) for r in stages[-1][1].collect())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in cp.run(spark, sf).collect()) == want


def test_classifier_stage(stages, spark, sf):
    docs, new = stages[0]
    scores = {r.doc_id: r.score for r in qm.score_quality(docs, table(spark, sf, "labels")).collect()}
    assert {r.doc_id for r in new.collect()} == {k for k, s in scores.items() if s >= 0.3}
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    kept = {r.doc_id for r in new.collect()}
    good = [k for k in scores if labels.get(k) == 1]
    assert sum(k in kept for k in good) >= 0.98 * len(good)


def test_near_duplicate_stage(stages):
    """All of a group but one go, of those that are 0.8 similar in 5-word shingles; nothing else goes."""
    docs, new = stages[1]
    root = brute({r.doc_id: shingle_set(r.text, 5) for r in docs.collect()})
    right = {k for k, r in root.items() if k == r}
    kept = {r.doc_id for r in new.collect()}
    assert right <= kept
    assert len(kept - right) <= 0.05 * (len(root) - len(right))


def without_repeats(texts: dict, words: int = 51) -> dict:
    """Texts without word sequences of ``words`` words that start twice, and the white space around."""
    spans = {k: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for k, t in texts.items()}
    split = {k: [t[a:b] for a, b in spans[k]] for k, t in texts.items()}
    windows = lambda w: (tuple(w[i : i + words]) for i in range(len(w) - words + 1))
    starts = collections.Counter(x for w in split.values() for x in windows(w))
    out = {}
    for k, t in texts.items():
        gone = {i + j for i, x in enumerate(windows(split[k])) if starts[x] > 1 for j in range(words)}
        at, kept = 0, ""
        for i, (a, b) in enumerate(spans[k]):
            if i not in gone:
                kept += t[a:b] if i - 1 in gone else t[at:b]
            at = b
        out[k] = kept + ("" if spans[k] and len(spans[k]) - 1 in gone else t[at:])
    return out


def test_repeat_stage(stages):
    docs, new = stages[2]
    want = without_repeats({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r for r in new.collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(want[k]) for k, r in got.items())
    assert any(len(want[r.doc_id]) < len(r.text) for r in docs.collect())


def test_short_words_and_side_by_side_repeats(spark, sf):
    """A passage of 60 short words goes; two shorter repeats side by side stay."""
    fill = iter(range(9999))
    own = lambda n: " ".join(f"u{next(fill)}" for _ in range(n))
    tiny = " ".join(chr(97 + i % 26) + chr(97 + i * 7 % 25) for i in range(60))
    one, two = own(35), own(35)
    rows = [(1, f"{own(60)} {tiny} {own(9)}"), (2, f"{own(9)}\n{tiny}\n\n{own(80)}"), (3, f"{own(70)} {one} {own(9)}"),
            (4, f"{own(20)} {two} {own(70)}"), (5, f"{own(50)} {one} {two} {own(50)}"), (6, tiny.upper()), (7, tiny)]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in cp.suffix_array(spark, docs, sf).collect()}
    assert got == without_repeats(dict(rows))
    assert all(got[k] == t for k, t in rows if k in (3, 4, 5, 6)) and got[7] == ""


def test_mixture_stage(stages):
    docs, new = stages[3]
    size = {r.doc_id: len(words_of(r.text)) for r in docs.collect()}
    taken = collections.Counter(r.doc_id for r in new.collect())
    by_source, target = collections.Counter(), {}
    for r in mix(docs, word_count("text")).collect():
        target[r.source] = r.target
        by_source[r.source] += taken[r.doc_id] * size[r.doc_id]
    assert max(taken.values()) <= 2
    for s, t in target.items():
        assert abs(by_source[s] - t) <= max(size.values())


def test_encoding_stage(stages):
    docs, new = stages[4]
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())
    want = collections.Counter((r.doc_id, (1, *sp.encode(r.text), 2)) for r in docs.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in new.collect()) == want


def test_stages_on_odd_rows(spark, sf, odd_docs, no_docs):
    for first in (odd_docs, no_docs):
        docs = first
        for _, f in cp.STAGES[:-1]:
            docs = materialise(f(spark, docs, sf), "odd")
            assert docs.columns == first.columns
        assert cp.STAGES[-1][1](spark, docs, sf).count() == docs.count()


def test_repeated_passages_of_51_words(spark, sf):
    """Planted 51-word passages under 400 bytes go; 40-word ones and clean documents stay."""
    word = lambda k: f"a{k % 9973:04d}"
    fill = iter(range(3000))
    own = lambda n: " ".join(word(next(fill)) for _ in range(n))
    long, short = [" ".join(word(5000 + i) for i in range(m, m + n)) for m, n in ((0, 51), (100, 40))]
    rows = [(1, f"{own(90)} b {long} c {own(70)}"), (2, f"{own(60)} d {long} e {own(80)}"), (3, own(200)),
            (4, f"{own(90)} {short} {own(70)}"), (5, f"{own(60)} {short} {own(80)}")]
    assert 200 < len(short) < len(long) < 400
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in cp.suffix_array(spark, docs, sf).collect()}
    for k, t in rows:
        assert got[k] == (t.replace(f" {long} ", "") if k <= 2 else t)


def test_stages_translate_no_text(spark, sf):
    """Words are split, and characters counted, without a pass over every single character of a text."""
    docs = table(spark, sf, "documents")
    for rows in (docs.select(word_count("text")), cp.quality_classifier(spark, docs, sf)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace" in plan and "translate(" not in plan
