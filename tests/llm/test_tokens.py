"""Token counts and the SentencePiece codec against the library."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from epispark.llm.bpe import piece_model
from epispark.llm.piece_codec import _encoder, _ids, decode, encode, round_trip
from epispark.llm.queries import QUERIES, table, tokenizer_path
from epispark.llm.token_counts import count_tokens

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def own_ids(texts):
    model = piece_model(tokenizer_path())
    words = [model.pretokens(t) for t in texts]
    distinct = list(dict.fromkeys(w for x in words for w in x))
    ids, n = model.encode_words(distinct)
    at = np.cumsum(n) - n
    known = {w: ids[a : a + k].tolist() for w, a, k in zip(distinct, at.tolist(), n.tolist())}
    return [sum((known[w] for w in x), []) for x in words]


def test_merging_equals_library(library):
    rnd = random.Random(1)
    parts = ["a", "b", "the", "e", " ", "  ", "\n", "é", "▁", "日", "\0", "😀", "<s>", "<0x41>", "1", "aaa", "ing", "%%%"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 60))) for _ in range(800)]
    texts += ["".join(rnd.choices("abcdeinrst", k=300)) for _ in range(200)]
    texts += ["a" * n for n in range(60)] + [" " * n for n in range(40)] + ["ab" * 3000, "x" * 20_000]
    assert own_ids(texts) == library.encode(texts)
    model = piece_model(tokenizer_path())
    for t in texts:
        ids = [1, *library.encode(t), 2]
        assert model.decode(np.array(ids)) == library.decode(ids)


def test_counts_of_odd_rows(spark, odd_docs, no_docs, texts, library):
    got = sorted(map(tuple, count_tokens(odd_docs, tokenizer_path()).collect()), key=str)
    want = []
    for k, t in texts:
        n = len(library.encode(t or ""))
        want.append((k, len((t or "").encode()), n, n > 4096))
    assert got == sorted(want, key=str)
    assert count_tokens(no_docs, tokenizer_path()).count() == 0


def test_round_trip_of_odd_rows(spark, odd_docs, no_docs, texts, library):
    got = sorted(map(tuple, round_trip(odd_docs, tokenizer_path()).collect()), key=str)
    want = []
    for k, t in texts:
        ids = [1, *library.encode(t or ""), 2]
        raw = np.array(ids, "<u4").tobytes()
        back = library.decode(ids).encode()
        want.append((k, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
    assert got == sorted(want, key=str)
    coded = encode(odd_docs, tokenizer_path())
    back = {(r.doc_id, r.text) for r in decode(coded, tokenizer_path()).collect()}
    assert back == {(k, library.decode(library.encode(t or ""))) for k, t in texts}
    assert round_trip(no_docs, tokenizer_path()).count() == 0


def test_queries_equal_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    counts = {r.doc_id: r.n_tokens for r in QUERIES["op5_token_counts"](spark, sf).collect()}
    assert counts == {k: len(library.encode(t)) for k, t in texts.items()}
    for r in QUERIES["op9_piece_codec"](spark, sf).collect():
        ids = [1, *library.encode(texts[r.doc_id]), 2]
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encoding_of_a_batch_takes_little_memory(library):
    """Two workers encode beside an executor's heap; a batch of whole texts goes through in small blocks."""
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdeinrst", k=9)) for _ in range(200)) for _ in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(900)), pa.array(texts)], names=["doc_id", "text"])
    run = _encoder(tokenizer_path(), True, _ids)
    list(run(iter([batch.slice(0, 1)])))  # the model's tables stay
    tracemalloc.start()
    made = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    ids = [i for b in made for i in b.column("ids").to_pylist()]
    assert ids == [[1, *library.encode(t), 2] for t in texts]
    assert peak < 100 << 20
