"""Text, JSON and conversation helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENT_TYPE = (
    "array<struct<start:int,end:int,level_1:string,level_2:string,level_3:string>>"
)
IGNORE = -100
# fixed values: conversation roles after mapping
ROLES = {"human": "user", "gpt": "assistant"}


def decode_text(raw: Column) -> Column:
    """Bytes to text with invalid sequences dropped."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def preview(text: Column, n: int = 48) -> Column:
    """Single-line preview of at most ``n`` characters."""
    return F.left(F.trim(F.translate(text, "\n", " ")), F.lit(n))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for blank text."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"\s+")))


def conversation_words(turns: Column) -> Column:
    """Words over the ``value`` fields of ``array<struct<from,value>>``."""
    return F.aggregate(turns, F.lit(0), lambda s, t: s + word_count(t["value"]))


def signed_length(words: Column, has_image: Column, image_bonus: int = 128) -> tuple:
    """Length estimate with the image bonus, and the length signed by modality."""
    return (
        words + F.when(has_image, F.lit(image_bonus)).otherwise(F.lit(0)),
        F.when(has_image, words).otherwise(-words),
    )


def map_role(role: Column) -> Column:
    out = role
    for src, dst in ROLES.items():
        out = F.when(role == src, F.lit(dst)).otherwise(out)
    return out


def normalise_turns(turns: Column) -> Column:
    """Drop a leading turn that is not from the user and map the role names."""
    mapped = F.transform(
        turns, lambda t: F.struct(map_role(t["from"]).alias("role"), t["value"].alias("content"))
    )
    return F.when(
        F.get(mapped, F.lit(0))["role"] != "user", F.slice(mapped, 2, F.size(mapped))
    ).otherwise(mapped)


def words_per_conversation(turns: DataFrame, key: str, text: str) -> DataFrame:
    """Word totals of a turn table; summed per key, so a long conversation is never collected."""
    return turns.groupBy(key).agg(F.sum(word_count(F.col(text))).alias("words"))


def user_first(turns: DataFrame, key: str, order: str, role: str) -> DataFrame:
    """Turn table with mapped roles, without a leading turn that is not the user's."""
    first = turns.groupBy(key).agg(
        F.min(order).alias("__first"), F.min_by(role, order).alias("__role")
    )
    lead = (F.col(order) == F.col("__first")) & (map_role(F.col("__role")) != "user")
    return (
        turns.join(first, key)
        .where(~lead)
        .withColumn(role, map_role(F.col(role)))
        .drop("__first", "__role")
    )


def expand_tags(
    text: Column, tag: str, pads: Column, start: str, pad: str, end: str
) -> Column:
    """Replace the n-th ``tag`` with ``start`` + ``pads[n]`` times ``pad`` + ``end``.

    Tags past the end of ``pads`` are replaced by an empty run.
    """
    import re

    parts = F.split(text, re.escape(tag), -1)
    glue = F.transform(
        parts,
        lambda p, i: F.when(i == 0, p).otherwise(
            F.concat(
                F.lit(start),
                F.repeat(F.lit(pad), F.coalesce(F.get(pads, i - 1), F.lit(0)).cast("int")),
                F.lit(end),
                p,
            )
        ),
    )
    return F.array_join(glue, "")


def target_mask(role: Column, tokens: Column, header: int = 3) -> Column:
    """Targets of one turn: everything ignored unless it is the assistant's text after the header."""
    n = F.size(tokens)
    kept = F.concat(
        F.array_repeat(F.lit(IGNORE), F.least(F.lit(header), n)),
        F.slice(tokens, header + 1, F.greatest(n - header, F.lit(0))),
    )
    return F.when(role == "assistant", kept).otherwise(F.array_repeat(F.lit(IGNORE), n))


def json_span(text: Column) -> Column:
    """Text from the first ``{`` to the last ``}``, over line breaks; null when there is none."""
    found = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def parse_json_span(text: Column, schema: str) -> Column:
    return F.from_json(json_span(text), schema)


def parse_segments(text: Column) -> Column:
    """Segment list from JSON text; anything else is an empty list."""
    return F.coalesce(F.from_json(text, SEGMENT_TYPE), F.array().cast(SEGMENT_TYPE))


def stored_frames(fps: Column, seconds: Column, size_bytes: Column, per_frame: int) -> Column:
    """Frame count ``round(fps * seconds)`` (half to even), else estimated from the size."""
    return F.coalesce(
        F.bround(fps * seconds).cast("long"), F.floor(size_bytes / per_frame), F.lit(0)
    )
