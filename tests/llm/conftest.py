from __future__ import annotations

import pytest

CLASHES = (
    "size target taken position n_words kept fp fingerprint component_id data spans row score "
    "predicted n_tokens ids h key kept_key mix_key span_id"
).split()
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    + ", ".join(f"{c} string" for c in CLASHES)
)
PASSAGE = " ".join(f"word{i} of a passage that is shared" for i in range(20))


def document_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows, near copies."""
    long_text = " ".join(f"w{i * 7919 % 5003}" for i in range(30_000))
    base = " ".join(f"term{i * 31 % 97} and line{i}" for i in range(120))
    texts = {
        1: base,
        2: base,
        3: base.replace("term31", "Term31"),
        4: base + " tail",
        5: "",
        6: None,
        7: " \t\n ",
        8: long_text,
        9: PASSAGE + " first ending here",
        10: "Other start. " + PASSAGE,
        11: "spam " * 90,
        12: "A### b$$$ c%%% d&&& " * 30,
        13: "one two three",
        14: "zażółć gęślą jaźń 日本語 😀 x ▁ <s> é y " * 12,
    }
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in texts.items()]
    rows += [rows[0], rows[0], rows[4], (None, None, None, None, None), (None, base, None, None, 1)]
    rows += [(20, PASSAGE, None, None, None)]
    return [r + ("x",) * len(CLASHES) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame(document_rows(), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1]) for r in document_rows()]
