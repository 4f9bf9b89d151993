"""64-bit hashes of the words and word shingles of whole texts, a bounded piece of text at a time."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

PIECE = 1 << 20  # bytes of text hashed at once
BASE = 0x9E3779B97F4A7C15  # odd, so that powers have inverses modulo 2 ** 64
WHITE = b"\t\n\x0b\x0c\r "
U = np.uint64


def mix(v: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    v = (v ^ (v >> U(32))) * U(0xD6E8FEB86659FD93)
    v = (v ^ (v >> U(29))) * U(0xBF58476D1CE4E5B9)
    return v ^ (v >> U(32))


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, ...]:
    power = np.cumprod(np.r_[U(1), np.full(PIECE, U(BASE))])
    inverse = np.cumprod(np.r_[U(1), np.full(PIECE, U(pow(BASE, -1, 1 << 64)))])
    value = np.random.default_rng(11).integers(1, 1 << 63, 256, np.int64).astype(U)
    lower = value.copy()
    lower[65:91] = value[97:123]
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    return power, inverse, value, lower, white


def _piece(data: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    power, inverse, value, low, white = _tables()
    raw = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], white[raw], [True]])
    starts = np.flatnonzero(gap[:-2] & ~gap[1:-1])
    ends = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
    if len(raw) > PIECE:  # one word that is longer than a piece
        body = data[starts[0] : ends[0]]
        digest = hashlib.blake2b(body.lower() if lower else body, digest_size=8).digest()
        return np.frombuffer(digest, U), starts, ends
    sums = np.concatenate([np.zeros(1, U), np.cumsum((low if lower else value)[raw] * power[: len(raw)])])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts, ends


def word_hashes(data: bytes, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word ``[^\\x20\\x09-\\x0D]+``; ``lower`` folds A-Z."""
    if len(data) <= PIECE:
        return _piece(data, lower)
    out, at = [], 0
    while at < len(data):
        stop = min(at + PIECE, len(data))
        if stop < len(data):  # up to the last white space, or over a word that has none
            cut = max(data.rfind(c, at, stop) for c in map(bytes, zip(WHITE)))
            if cut <= at:
                later = [x for x in (data.find(c, at + 1) for c in map(bytes, zip(WHITE))) if x > 0]
                cut = min(later, default=len(data))
            stop = cut
        h, s, e = _piece(data[at:stop], lower)
        out.append((h, s + at, e + at))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*out))


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes; of the whole sequence if it is shorter."""
    width = min(width, len(words))
    if not width:
        return words
    n = len(words) - width + 1
    out = np.full(n, U(width * 0x632BE59BD9B4E019 % (1 << 64)))
    for k in range(width):
        out = mix(out + words[k : k + n]) * U(BASE)
    return out
