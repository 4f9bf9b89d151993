"""Spelling variants: words one edit apart, found through words written in a reduced alphabet.

Letters are hashed to a few symbols. Words one edit apart have reduced forms that are equal or one
edit apart, so the full one-edit neighbourhood of every reduced form, joined with the reduced forms
that occur, finds them; the edit is verified on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epispark.llm.words import whole
from epispark.session import materialise

RUNS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))
SYMBOLS = 6
DROP_EVERY = 199


def lower_ascii(word: Column) -> Column:
    """``word`` with only A-Z lower-cased."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def vocabulary(
    docs: DataFrame, text: str = "text", key: str = "doc_id", shortest: int = 6, least: int = 5,
    drop_every: int = DROP_EVERY,
) -> DataFrame:
    """``word, n``: words of ``shortest`` code points or more that occur ``least`` times or more.

    A word is a maximal run of letters, A-Z lower-cased. Where ``drop_every`` divides the crc32 ``h``
    of ``<key>:<run>``, the code point ``h % length`` of the run is left out, a repeatable source of
    misspellings; 0 keeps every run as it is.
    """
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"),
        F.explode(F.regexp_extract_all(whole(text), F.lit(RUNS), F.lit(0))).alias("run"),
    )
    runs = runs.where(F.length("run") >= shortest).select("k", lower_ascii(F.col("run")).alias("word"))
    if drop_every:
        runs = runs.withColumn("h", F.crc32(F.concat("k", F.lit(":"), "word")))
        shorter = F.expr("concat(substring(word, 1, cast(h % length(word) as int)), substring(word, cast(h % length(word) as int) + 2))")
        runs = runs.withColumn("word", F.when(F.col("h") % drop_every == 0, shorter).otherwise(F.col("word")))
    counts = runs.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") >= least) & (F.length("word") >= shortest))


def reduced(word: Column, symbols: int = SYMBOLS) -> Column:
    """The word with each letter written as one of ``symbols`` digits, its code point modulo these."""
    return F.translate(word, LETTERS, "".join(str(ord(c) % symbols) for c in LETTERS))


def neighbourhood(form: str, symbols: int = SYMBOLS) -> Column:
    """All strings over the symbols within one edit of the reduced form, itself included."""
    digits = "array(" + ", ".join(f"'{s}'" for s in range(symbols)) + ")"
    return F.expr(
        f"""array_distinct(flatten(transform(sequence(0, length({form})), i -> concat(
          array(concat(substring({form}, 1, i), substring({form}, i + 2))),
          transform({digits}, s -> concat(substring({form}, 1, i), s, substring({form}, i + 2))),
          transform({digits}, s -> concat(substring({form}, 1, i), s, substring({form}, i + 1)))))))"""
    )


def near_words(vocab: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``word, n, near, near_n``: every ordered pair of words exactly one edit apart.

    ``vocab`` (``word, n``) is read several times: pass a written table. Joins are shuffled at every size: Spark
    sizes an exploded side as if it had no more rows than its source, and would broadcast neighbourhoods.
    """
    forms = materialise(vocab.select("word", "n", reduced(F.col("word"), symbols).alias("form")), "reduced")
    distinct = materialise(forms.select("form").distinct(), "reduced-forms")
    # the written forms are a few small files, their neighbourhoods a hundred times as many rows
    dealt = distinct.repartition(int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    around = dealt.select("form", F.explode(neighbourhood("form", symbols)).alias("other"))
    around = around.select("form", F.xxhash64("other").alias("hash"))
    there = distinct.select(F.col("form").alias("near_form"), F.xxhash64("form").alias("there"))
    met = materialise(around.hint("merge").join(there, F.col("hash") == F.col("there")).select("form", "near_form"), "near-forms")
    other = forms.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("form").alias("f"))
    pairs = forms.hint("merge").join(met, "form").drop("form")
    pairs = pairs.join(other.hint("merge"), F.col("near_form") == F.col("f"))
    return pairs.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(forms: DataFrame, rounds: int = 64) -> DataFrame:
    """``word, root`` of every word of ``word, form``: the last word on its way along the forms.

    Paths double in each round. A form is more frequent than its word by a factor, so a way is short.
    """
    links = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(rounds):
        step = links.select(F.col("word").alias("w"), F.col("root").alias("next"))
        moved = links.join(step.hint("merge"), F.col("root") == F.col("w"), "left")
        moved = materialise(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("w").isNotNull().alias("on")), "forms")
        links = moved.select("word", "root")
        if moved.where("on").isEmpty():
            return links
    raise RuntimeError("the forms of a word do not end")


def spelling_variants(
    docs: DataFrame, text: str = "text", key: str = "doc_id", ratio: int = 5, symbols: int = SYMBOLS, **how
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the :func:`vocabulary`.

    ``form`` is the word's near word with the largest count (ties: smallest in code-point order), if
    that is at least ``ratio`` times its own, else null; ``root`` is reached by following forms, the
    word itself if it has none.

    Null texts count as empty, null keys as the empty text; repeated rows count as often as they
    occur; words may be of any length; an empty table gives an empty table; other columns are not
    read. Texts are read once. Pairs are summed up per word map-side, so frequent reduced forms and
    words with many neighbours gather nothing in one task. The vocabulary grows with the documents, so no
    join broadcasts it.
    """
    vocab = materialise(vocabulary(docs, text, key, **how), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near"))).alias("best")
    near = near_words(vocab, symbols).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    rows = vocab.join(near.hint("merge"), "word", "left").withColumn("form_n", -F.col("best.minus"))
    takes = F.col("form_n") >= ratio * F.col("n")
    rows = rows.select(
        "word", F.when(takes, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("form_n")).alias("form_n"),
    )
    rows = materialise(rows, "variants")
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
