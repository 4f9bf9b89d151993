"""Quality rules as a bitmask ledger: every rule is evaluated once, policies only read bits.

Main path: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.words import whole, word_array

SYMBOLS = "#*$%&|<>"

#: Rules in bit order: a condition over the measurements that holds where the text fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_upper > 40 * word_chars",
}
#: Versions of the policy: the rules that count. Old ones stay, so that old decisions can be redone.
POLICIES: dict[str, Sequence[str]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def mask(policy: str | Sequence[str]) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    return sum(1 << list(RULES).index(n) for n in names)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    windows = _let(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(
                F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")
            ),
        ),
    )

    def twins(s):
        same = lambda x, i: F.coalesce(F.get(s, i)["t"] == x["t"], F.lit(False))
        return F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1))

    starts = F.array_sort(F.transform(_let(F.array_sort(windows), twins), lambda x: x["i"]))
    return F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )


def measure(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the measurements of each whole text; null text counts as empty.

    Repeated 3-word windows are first looked for among 64-bit hashes, where equal windows are always
    equal; only texts with such a pair compare the windows themselves. No shuffle.
    """
    t = F.col("__text")
    src = docs.select(*keep, whole(text).alias("__text"))
    src = src.withColumn("__words", word_array(t))
    words = F.col("__words")
    hashes = _let(
        words,
        lambda ws: F.transform(
            F.slice(ws, 3, F.greatest(F.size(ws) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), w),
        ),
    )
    src = src.withColumn("__hash", hashes)
    repeats = F.size(F.array_distinct("__hash")) < F.size("__hash")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(F.translate(x, "\t\n\x0b\x0c\r", "")) != "")
    src = src.withColumn("__lines", lines)
    bare = F.translate(t, " \t\n\x0b\x0c\r", "")
    long = lambda c, name: c.cast("long").alias(name)
    return src.select(
        *keep,
        long(F.size(words), "n_words"),
        long(F.length(bare), "word_chars"),
        long(F.length(t) - F.length(F.translate(t, SYMBOLS, "")), "n_symbols"),
        long(F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", "")), "n_upper"),
        long(F.size("__lines"), "n_lines"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines")), "n_dup_lines"),
        long(F.when(repeats, _covered(words)).otherwise(0), "n_repeat_words"),
    )


def ledger(
    docs: DataFrame,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    rules: Mapping[str, str] = RULES,
) -> DataFrame:
    """Measurements and ``failed_bits``, bit k set where rule k fails; at most 63 rules.

    Write the ledger before policies filter it: a filter on an unwritten one makes Spark evaluate the
    measurements once more for every mention.
    """
    bits = [F.when(F.expr(c), F.lit(1 << k)).otherwise(0) for k, c in enumerate(rules.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, text, keep).withColumn("failed_bits", total.cast("long"))


def apply_policy(rows: DataFrame, policy: str | Sequence[str], name: str = "kept") -> DataFrame:
    """Adds ``name``: true where no rule of the policy fails."""
    return rows.withColumn(name, F.col("failed_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablations(rows: DataFrame, policy: str | Sequence[str] = "v1") -> DataFrame:
    """Per rule of the policy: rows that fail it, and rows kept if only this rule went.

    One aggregation over the ledger's bits, whatever the number of rules.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask(names)))
    sums = []
    for n in names:
        bit = F.lit(mask([n]))
        sums += [
            F.sum((bits.bitwiseAND(bit) != 0).cast("long")).alias(f"f_{n}"),
            F.sum((bits == bit).cast("long")).alias(f"o_{n}"),
        ]
    row = F.inline(
        F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"f_{n}"), F.lit(0)).alias("failed"),
                           F.coalesce(F.col(f"o_{n}"), F.lit(0)).alias("only_this")) for n in names])
    )
    return rows.agg(*sums).select(row)


def filter_quality(docs: DataFrame, policy: str = "v1", text: str = "text", keep=("doc_id",)) -> DataFrame:
    """Ledger with ``base_failed`` and ``kept`` under a policy.

    Null and empty texts have no word and fail; rows with null or repeated keys are judged one by
    one; an empty table gives an empty table; other columns are not read.
    """
    rows = apply_policy(ledger(docs, text, keep), policy)
    base = F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.withColumn("base_failed", base).withColumn("kept", F.col("kept") & ~F.col("base_failed"))
