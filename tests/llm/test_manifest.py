"""The Merkle manifest against a tree built row by row."""

from __future__ import annotations

import collections
import hashlib
import zlib

from epispark.llm.merkle import verify_manifest


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields) -> str:
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root and, for each leaf, its siblings level by level."""
    paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 3 * 3 : k // 3 * 3 + 3]
            paths[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
        at = [k // 3 for k in at]
    return level[0], paths


def expected(rows) -> list[tuple]:
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        cut = text if text is None else text.replace("\n", "")
        hit = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 2 == 0
        one = leaf(doc_id, source, lang, n_chars, text)
        two = leaf(doc_id, source, lang, n_chars, cut) if hit else one
        groups[source].append((doc_id is not None, doc_id or 0, one, two, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for rows_ in groups.values():
        rows_.sort()
    trees = [tree([r[2] for r in groups[s]]) for s in names]
    root, tops = tree([t[0] for t in trees])
    out = []
    for name, (subroot, paths), top in zip(names, trees, tops):
        for row, path in zip(groups[name], paths):
            path, folded = path + top, row[3]
            for a, b in path:
                folded = sha(a + folded + b)
            proof = sha("".join(a + b for a, b in path))
            out.append((row[4], row[2], subroot, root, proof, folded, folded == root))
    return out


def result(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def counted(rows):
    return collections.Counter(map(repr, rows))


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in odd_docs.collect()]
    assert counted(result(verify_manifest(odd_docs))) == counted(expected(rows))


def test_many_sources_and_depths(spark):
    rows = [(i, f"line {i}\nand more" if i % 3 else None, "en", f"s{i % 40}" if i % 2 else "hot", i) for i in range(401)]
    rows += [(7, "same\ntext", None, None, None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = result(verify_manifest(docs))
    assert counted(got) == counted(expected(rows))
    assert {r[-1] for r in got} == {True, False}


def test_one_leaf_and_none(spark, no_docs):
    docs = spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert result(verify_manifest(docs)) == expected([(1, "x", "en", "s", 1)])
    assert verify_manifest(no_docs).count() == 0
