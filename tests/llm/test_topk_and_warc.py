"""Exact top-k and WARC round trips against brute force."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random

from pyspark.sql import functions as F

from epispark.llm import warc
from epispark.llm.topk import top_k
from epispark.session import scratch_path


def test_topk_with_ties_and_odd_vectors(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-1.0, -0.5, 0.25, 0.5]) for _ in range(20)]) for i in range(700)]
    rows += [(700, None), (701, [None] * 20), (702, [float("nan")] * 20), (703, [float("inf")] * 20),
             (None, [1.0] * 20), (704, [1.0] * 8), (705, []), (710, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x"))
    got = top_k(df, F.col("vec_id") % 100 == 0, block_rows=150).collect()
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in [i for i in ints if i % 100 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:10])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0
    few = df.where("vec_id IN (100, 3, 4)")
    assert top_k(few, F.col("vec_id") % 100 == 0).count() == 2


def page_rows():
    big = "x" * 300_000
    rows = [(5, "http://a/1", "same"), (3, "http://a/2", "same"), (9, None, "same"), (1, "u\r\nInjected: 1", None),
            (2, "http://b", ""), (7, "é", big), (8, "é", big), (4, "http://c", "WARC/1.1\r\n\r\n"), (None, "n", "same"),
            (3, "http://a/2", "same"), (6, "z", "only é 日本")]
    return [r + ("clash", b"x") for r in rows]


def expected(rows):
    body = lambda h: (h or "").encode()
    first = {}
    for k, _, h, *_ in rows:
        if k is not None:
            first[body(h)] = min(first.get(body(h), 1 << 60), k)
    out = []
    for k, _, h, *_ in rows:
        b = body(h)
        own = k == first[b]
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                    "response" if own else "revisit", None if own else first[b]))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    schema = "page_id long, url string, html string, record_type string, payload binary"
    pages = spark.createDataFrame(page_rows(), schema)
    path = scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    assert sorted(map(tuple, warc.archive_digest(spark, path).collect()), key=str) == expected(page_rows())
    full = warc.read_archive(spark, path)
    assert full.where("record_type = 'response' AND target_uri LIKE 'http://a%'").count() == 2
    assert full.where("target_uri = 'u%0D%0AInjected: 1'").count() == 1
    assert full.where(F.col("record_type").isin("revisit", "none")).select("payload").distinct().collect() == [(None,)]
    empty = scratch_path(spark, "warc-test")
    warc.write_archive(pages.where("false"), empty)
    assert warc.archive_digest(spark, empty).count() == 0


class Memory:
    def __init__(self, data):
        self.data, self.reads = data, 0

    def size(self):
        return len(self.data)

    def read_at(self, n, pos):
        self.reads += n
        return self.data[pos : pos + n]


def test_reader_skips_payloads_and_reads_foreign_files():
    noise = random.Random(1).randbytes(1 << 21).hex().encode()
    rows = [dict(record_type=t, record_id=f"urn:{i}", target_uri="http://x", warc_date=None, payload_digest=None,
                 refers_to=None, payload=noise) for i, t in enumerate(["response", "request", "response"])]
    plain = [warc._record(r) for r in rows]
    for data in (
        b"".join(map(warc._member, plain)),
        b"".join(gzip.compress(p, 1) for p in plain),
        b"".join(plain),
    ):
        file = Memory(data)
        heads = list(warc.records(warc._Bytes(file), lambda r: r["record_type"] == "request", False, False))
        assert [(r["record_id"], r["payload_length"], r["payload"]) for r in heads] == [("urn:1", len(noise), None)]
        if data[:4] == b"\x1f\x8b\x08\x04" or data[:4] == b"WARC":
            assert file.reads < len(data)
        got = list(warc.records(warc._Bytes(Memory(data)), lambda r: True, True, False))
        assert [r["payload"] for r in got] == [noise] * 3
