"""Deep-shallow sorting of strings that share their first bytes, with common-prefix lengths.

Multikey quicksort, on eight bytes at a time and on all segments at once, goes to a shallow depth;
what is still equal there is ordered by blind tries, which look at branching bytes only on the way
down and compare each string with one leaf.
"""

from __future__ import annotations

import numpy as np

WORD = 8
SHALLOW = 2 * WORD


def common_prefix(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common prefix, known to be ``low`` at least."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Inner nodes ``[depth, {byte: child}]``, leaves lists of equal strings' numbers.

    The byte at a string's end is -1, before all others.
    """

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def _byte(self, n: int, depth: int) -> int:
        s = self.strings[n]
        return s[depth] if depth < len(s) else -1

    def add(self, n: int) -> None:
        if self.root is None:
            self.root = (None, [n])
            return
        node = self.root
        while node[0] is not None:  # blind: any child where no byte fits
            child = node[1].get(self._byte(n, node[0]))
            node = child if child is not None else next(iter(node[1].values()))
        s, other = self.strings[n], self.strings[node[1][0]]
        same = common_prefix(s, other)
        if same == len(s) == len(other):
            node[1].append(n)
            return
        parent, node = None, self.root
        while node[0] is not None and node[0] < same:
            parent, node = node, node[1][self._byte(n, node[0])]
        mine = (None, [n])
        if node[0] == same:
            node[1][self._byte(n, same)] = mine
            return
        inner = (same, {(other[same] if same < len(other) else -1): node, self._byte(n, same): mine})
        if parent is None:
            self.root = inner
        else:
            parent[1][self._byte(n, parent[0])] = inner

    def walk(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and for each the common prefix with the one before."""
        order, lcp, stack = [], [], [(self.root, 0)]
        while stack:
            (depth, below), up = stack.pop()
            if depth is None:
                size = len(self.strings[below[0]])
                order += below
                lcp += [up] + [size] * (len(below) - 1)
            else:
                keys = sorted(below)
                stack += [(below[k], depth) for k in reversed(keys[1:])]
                stack.append((below[keys[0]], up))
        return order, lcp


def deep_shallow_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings, a proper prefix first, and each one's common prefix with the one before."""
    n = len(strings)
    if n > 1 and n <= 64:  # a shallow phase doesn't pay for few strings
        trie = BlindTrie(strings)
        for i in range(n):
            trie.add(i)
        order, lcp = trie.walk()
        return np.array(order), np.array(lcp)
    head = b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings)
    words = np.frombuffer(head, ">u8").reshape(n, -1).astype(np.uint64)
    order = np.arange(n)
    seg, depth = np.zeros(n, np.int64), np.zeros(n, np.int64)
    while True:  # ternary partition of every open segment around its middle element
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        size = np.diff(np.r_[first, n])
        row = np.repeat(np.arange(len(first)), size)
        open_ = (size > 1)[row] & (depth < words.shape[1])
        if not open_.any():
            break
        at = np.minimum(depth, words.shape[1] - 1)
        value = words[order, at]
        pivot = value[(first + size // 2)][row]
        side = np.where(open_, (value > pivot).astype(np.int64) - (value < pivot) + 1, 1)
        move = np.argsort(row * 3 + side, kind="stable")
        new = (row * 3 + side)[move]
        order, depth = order[move], (depth + ((side == 1) & open_))[move]
        seg = np.cumsum(np.r_[0, new[1:] != new[:-1]])
    lcp = np.zeros(n, np.int64)
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    for lo, hi in zip(first.tolist(), np.r_[first[1:], n].tolist()):
        if hi - lo > 1:
            trie = BlindTrie(strings)
            for i in order[lo:hi].tolist():
                trie.add(i)
            order[lo:hi], lcp[lo:hi] = trie.walk()
    for i in first[1:].tolist():
        lcp[i] = common_prefix(strings[order[i - 1]], strings[order[i]])
    return order, lcp
