"""Hashes, keys and path strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MERSENNE_31 = 2**31 - 1
# fixed values: file stems that name a container, not an episode; folders skipped above such a file
GENERIC_STEMS = ["trajectory"]
GENERIC_FOLDER = "data"


def short_sha256(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, n)


def episode_hash(episode_id: Column) -> Column:
    """12 hex digits of the id; an empty id is an error."""
    checked = F.when(episode_id != "", episode_id).otherwise(
        F.raise_error(F.lit("episode id must not be empty"))
    )
    return short_sha256(checked)


def filename_hash(source: Column, version: Column, index: Column) -> Column:
    text = F.concat_ws(":", source, version, index.cast("string"))
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def index_set_hash(indices: Column, n: int = 6) -> Column:
    """Order-insensitive hash of a set of indices (JSON list text, no spaces)."""
    return F.substring(F.sha1(F.to_json(F.array_sort(indices)).cast("binary")), 1, n)


def episode_key(index: Column) -> Column:
    """``ep_`` plus the index, zero-filled to eight digits (wider numbers keep all digits)."""
    return F.format_string("ep_%08d", index)


def parse_episode_key(key: Column) -> Column:
    """Index of an episode key, null when malformed."""
    digits = F.regexp_extract(key, r"^ep_(\d+)$", 1)
    return F.when(digits != "", digits.try_cast("long"))


def id_from_hash(text: Column) -> Column:
    """Non-negative integer id below 2^31-1 from the first 12 hex digits of SHA-256."""
    return F.conv(short_sha256(text), 16, 10).cast("long") % MERSENNE_31


def hash_uniform(*parts: Column) -> Column:
    """Uniform number in [0, 1) that depends only on the given values.

    52 bits of MD5, so any engine reproduces the same draw.
    """
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(
        2**52
    )


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def parent_dir(path: Column) -> Column:
    """Name of the nearest folder that is not the generic payload folder."""
    folder = F.regexp_replace(path, r"/[^/]*$", "")
    return F.regexp_extract(F.regexp_replace(folder, rf"(/{GENERIC_FOLDER})+$", ""), r"([^/]*)$", 1)


def readable_id(path: Column, generic: list[str] | None = None) -> Column:
    """The stem, or the parent folder's name when the stem is a generic container name."""
    stem = path_stem(path)
    return F.when(stem.isin(generic or GENERIC_STEMS), parent_dir(path)).otherwise(stem)


def fill_template(template: str, **values: Column) -> Column:
    """Fill ``{name}`` and ``{name:03d}`` fields of a path template with columns."""
    import re

    args: list[Column] = []

    def field(m: re.Match) -> str:
        args.append(values[m.group(1)])
        return f"%{m.group(2)}" if m.group(2) else "%s"

    return F.format_string(
        re.sub(r"\{(\w+)(?::(\d*d))?\}", field, template.replace("%", "%%")), *args
    )


def chunk_of(index: Column, size: int) -> Column:
    return F.floor(index / size)


def fingerprint(v: Column, text: Column, decimals: int = 4) -> Column:
    """Content hash of a rounded vector, of the text where there is no vector."""
    rounded = F.array_join(
        F.transform(v, lambda x: F.format_string(f"%.{decimals}f", F.round(x, decimals))), ","
    )
    return F.sha1(F.coalesce(rounded, text).cast("binary"))
