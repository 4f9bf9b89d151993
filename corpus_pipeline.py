"""Training corpus pipeline: classify, drop near-duplicates, cut repeats, mix sources, encode.

Every stage works on all its predecessor kept. Stages but the last return the columns of
``documents``; the last one returns ``doc_id, lang, source, n_tokens, ids`` for each row of the mix,
where a document stands as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epispark.llm.mixing import draw
from epispark.llm.piece_codec import encode
from epispark.llm.quality_model import keep_good
from epispark.llm.queries import table, tokenizer_path
from epispark.llm.shingle_simhash import keep_first_similar
from epispark.llm.suffix_dedup import remove_repeats
from epispark.llm.words import word_count
from epispark.session import materialise

#: A repeated passage goes from so many words on.
PASSAGE_WORDS = 51


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from ``labels`` outside the held-out fold."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8) the document with the smallest doc_id."""
    return keep_first_similar(docs)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of over 50 words that occur more than once."""
    return remove_repeats(docs, words=PASSAGE_WORDS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often as it takes them, in training order."""
    return draw(docs, word_count("text"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text, with begin and end."""
    rows = encode(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", suffix_array),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding", sentencepiece),
]

#: Classifier, SimHash and piece merging can't be said in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
