"""Side-by-side comparison of the registered queries with their SQL oracles.

``python -m tests.oracle [sf_dir] [name-fragment ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def kind(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "long", "int64"):
        return "long"
    if t in ("int", "integer"):
        return "int"
    if t in ("varchar", "string"):
        return "string"
    return t


def compare(df, con, sql) -> str:
    """'' when equal, else what differs: columns, types, row count or values."""
    names = sorted(df.columns)
    spark_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    rel = con.sql(sql)
    duck_types = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types)}
    if names != sorted(rel.columns):
        return f"columns {names} vs {sorted(rel.columns)}"
    if spark_types != duck_types:
        diff = {n: (spark_types[n], duck_types[n]) for n in names if spark_types[n] != duck_types[n]}
        return f"types {diff}"
    got = sorted(tuple(cell(row[n]) for n in names) for row in df.collect())
    order = [rel.columns.index(n) for n in names]
    want = sorted(tuple(cell(row[i]) for i in order) for row in rel.fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {names} {bad[0]}" if bad else ""


def main(argv: list[str]) -> int:
    from epispark.plans import REGISTRY
    from epispark.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8)
    con = connect(sf)
    failed = 0
    for name, q in REGISTRY.items():
        if argv[1:] and not any(a in name for a in argv[1:]):
            continue
        start = time.time()
        try:
            df = q.build(spark, sf)
            if q.oracle:
                verdict = compare(df, con, q.oracle) or f"ok {df.count() if argv[1:] else ''}"
            else:
                verdict = f"ok rows-only {df.count()}"
        except Exception as err:  # noqa: BLE001
            verdict = f"ERROR {type(err).__name__}: {str(err)[:1500]}"
        if not verdict.startswith("ok"):
            failed += 1
        print(f"{name:44s} {time.time() - start:6.2f}s {verdict}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
