"""Vectorised byte-pair merging for SentencePiece BPE models.

A text is cut into pre-tokens that no vocabulary piece can cross; distinct pre-tokens of a batch are
held as one flat (ragged) numpy symbol array and merged in synchronous rounds: the segmented minimum
gives each word's lowest pair rank, that pair is merged in all words at once, the array is compacted,
and words without a mergeable pair retire.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import numpy as np

SPACE = "▁"
NO_PAIR = np.int64(1) << 40
SHIFT = 22  # symbol codes, vocabulary ids or code points behind them, fit into 22 bits


class PieceModel:
    """Tables of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = n = sp.get_piece_size()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = {
            p: i
            for i, p in enumerate(pieces)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))
        }
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("pieces that span words are not supported")
        self.breaks = "" if any("\n" in p for p in normal) else "\n"
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        # rank: position in descending score; equal scores share a rank and go by position
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1]
        keys, merged = [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                left, right = normal.get(p[:k]), normal.get(p[k:])
                if left is not None and right is not None:
                    keys.append((left << SHIFT) | right)
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int64)[order], 0)
        self.pair_rank = np.append(rank[self.merged[:-1]].astype(np.int64), NO_PAIR)
        self.byte_id = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # surfaces for decoding: bytes of each id, empty for control ids
        surface = [b""] * n
        for p, i in normal.items():
            surface[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id):
            surface[i] = bytes([b])
        unknown = sp.unk_id()
        if unknown >= 0:
            surface[unknown] = " ⁇ ".encode()
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.starts_word = np.array([p.startswith(SPACE) and p in normal for p in pieces])
        b = re.escape(self.breaks)
        self.pattern = re.compile(f"{SPACE}+[^{SPACE}{b}]*|[^{SPACE}{b}]+" + (f"|{b}" if b else ""))

    def pretokens(self, text: str) -> list[str]:
        """Pieces of the normalised text (dummy prefix, escaped spaces) that merge on their own."""
        return self.pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left << SHIFT) | right
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.pair_rank[at], NO_PAIR), self.merged[at]

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, concatenated, and each word's number of ids."""
        n = len(words)
        if n == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        sym = self.char_id[points].astype(np.int64)
        sym = np.where(sym < 0, self.size + points.astype(np.int64), sym)
        word = np.repeat(np.arange(n), lengths)
        rank = np.full(len(sym), NO_PAIR)
        into = np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner], into[inner] = self._lookup(sym[inner], sym[inner + 1])
        out_word, out_sym = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, first)
            low = np.repeat(low, np.diff(np.r_[first, len(sym)]))
            live = low < NO_PAIR
            if not live.all():
                out_word.append(word[~live])
                out_sym.append(sym[~live])
                word, sym, rank, into, low = (x[live] for x in (word, sym, rank, into, low))
                if not len(sym):
                    break
            at = self._chosen(word, sym, rank, into, low)
            sym[at] = into[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            fresh = np.zeros(len(sym), bool)
            fresh[at] = True
            word, sym, rank, into, fresh = (x[keep] for x in (word, sym, rank, into, fresh))
            fresh[:-1] |= fresh[1:]  # pairs of the merged symbols and of those before them
            new = np.flatnonzero(fresh)
            rank[new] = NO_PAIR
            new = new[new + 1 < len(sym)]
            new = new[word[new] == word[new + 1]]
            rank[new], into[new] = self._lookup(sym[new], sym[new + 1])
        word, sym = np.concatenate(out_word), np.concatenate(out_sym)
        order = np.argsort(word, kind="stable")
        return self._fall_back(word[order], sym[order], n)

    def _chosen(self, word, sym, rank, into, low) -> np.ndarray:
        """Positions whose pair merges in this round, as one-by-one leftmost merging would do.

        Of overlapping pairs the left one merges. A word's later pairs wait if an earlier merge
        makes a pair of equal or lower rank, which would come first.
        """
        at = np.flatnonzero(rank == low)
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        offset = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        at = at[offset % 2 == 0]
        w = word[at]
        several = np.zeros(len(at), bool)
        several[1:] = w[1:] == w[:-1]
        several[:-1] |= several[1:]
        if not several.any():
            return at
        check = at[several]
        r, m, cw, last = rank[check], into[check], word[check], len(sym) - 1
        prev = np.maximum(check - 1, 0)
        left = sym[prev].copy()
        joined = np.r_[False, (np.diff(check) == 2) & (cw[1:] == cw[:-1])]
        left[joined] = m[np.flatnonzero(joined) - 1]
        has_left = (check > 0) & (word[prev] == cw)
        nxt = np.minimum(check + 2, last)
        has_right = (check + 2 <= last) & (word[nxt] == cw)
        bad = (has_left & (self._lookup(left, m)[0] <= r)) | (
            has_right & (self._lookup(m, sym[nxt])[0] <= r)
        )
        before = np.cumsum(bad) - bad
        head = np.flatnonzero(np.r_[True, cw[1:] != cw[:-1]])
        before -= np.repeat(before[head], np.diff(np.r_[head, len(check)]))
        ok = np.ones(len(at), bool)
        ok[several] = before == 0
        return at[ok]

    def _fall_back(self, word, sym, n) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters outside the vocabulary by the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(sym >= self.size)
        if len(odd):
            raw = [chr(c).encode() for c in (sym[odd] - self.size).tolist()]
            width = np.ones(len(sym), np.int64)
            width[odd] = np.fromiter(map(len, raw), np.int64, len(raw))
            unknown = np.repeat(sym >= self.size, width)
            word, sym = np.repeat(word, width), np.repeat(sym, width)
            sym[unknown] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.bincount(word, minlength=n)

    def surface_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the decoded ids, without the dummy prefix."""
        ids = ids[self.surface_len[ids] > 0]
        if not len(ids):
            return b""
        width = self.surface_len[ids]
        shift = np.repeat(self.surface_at[ids] - (np.cumsum(width) - width), width)
        data = self.surface[shift + np.arange(len(shift))]
        return data[1:].tobytes() if self.starts_word[ids[0]] else data.tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.surface_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    """The model's tables, built once per Python worker."""
    return PieceModel(path)


def blocks(texts: Sequence[str | None], chars: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``chars`` characters, one text at least."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
