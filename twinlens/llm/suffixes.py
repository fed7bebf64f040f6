"""Suffixes in order, compared by hashes: prefix polynomial hashes, binary search for the common extension, merge sort.

All steps work on whole arrays of suffixes. Hashes are taken modulo 2**64; two different strings may share one, so an order is
verified byte by byte at the end and made anew with another base if a collision has spoilt it.
"""

from __future__ import annotations

import numpy as np

#: Odd multipliers, tried in turn.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Rows of bytes that a verification lays out at once.
ROWS = 1 << 16
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n at least."""
    have = _tables.get(base)
    if have is None or len(have[0]) <= n:
        size = 1 << max(10, int(n + 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            t = np.full(size, b, dtype=np.uint64)
            t[0] = 1
            out.append(np.multiply.accumulate(t))
        have = _tables[base] = (out[0], out[1])
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on each other."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Prefixes:
    """Prefix hashes of a text (bytes as an array)."""

    def __init__(self, text: np.ndarray, base: int = BASES[0]):
        self.text, (up, self.down) = text, powers(base, len(text))
        self.sums = np.zeros(len(text) + 1, dtype=np.uint64)
        np.cumsum((text + np.uint64(1)) * up[: len(text)], out=self.sums[1:])

    def windows(self, size: int) -> np.ndarray:
        """The hash of every substring of ``size`` bytes."""
        n = len(self.text) - size + 1
        return (self.sums[size:] - self.sums[:n]) * self.down[:n]

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def common(self, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
        """The common extension of the suffixes at i and j, up to ``most`` bytes, by binary search."""
        out = np.full(len(i), most, dtype=np.int64)
        at = np.flatnonzero(self.of(i, most) != self.of(j, most))
        low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), most - 1, dtype=np.int64)
        a, b = i[at], j[at]
        for _ in range(int(most).bit_length()):
            middle = (low + high + 1) >> 1
            same = self.of(a, middle) == self.of(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        out[at] = low
        return out

    def before(self, i: np.ndarray, j: np.ndarray, most: int, ties: bool) -> np.ndarray:
        """Whether the suffix at i comes before that at j; ``ties``: or is its equal over ``most`` bytes."""
        n = self.common(i, j, most)
        inside = np.minimum(n, most - 1)
        return np.where(n == most, ties, self.text[i + inside] < self.text[j + inside])


def merge_sorted(hashes: Prefixes, at: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """The order of suffixes ``at`` inside groups, which are contiguous; suffixes are compared over ``most`` bytes.

    A merge sort over all groups at once: runs double in length, and an element finds its place in the sibling run by binary
    search. Runs that follow each other in order are left alone.
    """
    n = len(at)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.concatenate([starts, [n]]))
    order, width = np.arange(n), 1
    while len(sizes) and width < int(sizes.max()):
        big = sizes > width
        first, size = starts[big], sizes[big]
        pairs = (size - width + 2 * width - 1) // (2 * width)  # those with a second run
        left = np.repeat(first, pairs) + 2 * width * (np.arange(pairs.sum()) - np.repeat(np.cumsum(pairs) - pairs, pairs))
        middle = left + width
        right = np.minimum(middle + width, np.repeat(first + size, pairs))
        apart = ~hashes.before(at[order[middle - 1]], at[order[middle]], most, ties=True)
        left, middle, right = left[apart], middle[apart], right[apart]
        if len(left):
            counts = right - left
            pair = np.repeat(np.arange(len(left)), counts)
            slot = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + left[pair]
            is_left = slot < middle[pair]
            own = at[order[slot]]
            low = np.where(is_left, middle[pair], left[pair])
            base, high = low.copy(), np.where(is_left, right[pair], middle[pair])
            while (todo := np.flatnonzero(low < high)).size:
                m = (low[todo] + high[todo]) >> 1
                other = at[order[m]]
                # from the left run: before it come the right run's smaller ones; from the right run: the left run's smaller or equal ones
                goes = np.empty(len(todo), dtype=bool)
                for side, ties in ((True, False), (False, True)):
                    k = np.flatnonzero(is_left[todo] == side)
                    goes[k] = hashes.before(other[k], own[todo[k]], most, ties)
                low[todo], high[todo] = np.where(goes, m + 1, low[todo]), np.where(goes, high[todo], m)
            place = left[pair] + np.where(is_left, slot - left[pair], slot - middle[pair]) + low - base
            order[place] = order[slot]
        width *= 2
    return order


def classes(text: np.ndarray, at: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    """A class for each suffix ``at`` (groups contiguous): equal where group and first ``size`` bytes are; from the suffix order."""
    n = len(at)
    if not n:
        return np.zeros(0, dtype=np.int64)
    for base in BASES:
        hashes = Prefixes(text, base)
        order = merge_sorted(hashes, at, group, size)
        a, b = at[order[:-1]], at[order[1:]]
        inside = group[order[:-1]] == group[order[1:]]
        n_common = np.where(inside, hashes.common(a, b, size), 0)
        if verified(text, a, b, n_common, inside, size):
            break
    else:
        order = np.array(sorted(range(n), key=lambda k: (group[k], text[at[k] : at[k] + size].tobytes())))
        a, b = at[order[:-1]], at[order[1:]]
        inside = group[order[:-1]] == group[order[1:]]
        n_common = np.array([size if x and text[i : i + size].tobytes() == text[j : j + size].tobytes() else 0 for i, j, x in zip(a, b, inside, strict=True)], dtype=np.int64)
    out = np.empty(n, dtype=np.int64)
    out[order] = np.concatenate([[0], np.cumsum(~(inside & (n_common == size)))])
    return out


def verified(text: np.ndarray, a: np.ndarray, b: np.ndarray, common: np.ndarray, inside: np.ndarray, size: int) -> bool:
    """Whether neighbours in order have the bytes in common that their hashes say, and are in order after them."""
    span = np.arange(size)
    for k in range(0, len(a), ROWS):
        at = k + np.flatnonzero(inside[k : k + ROWS])
        if not len(at):
            continue
        x, y, n = text[a[at][:, None] + span], text[b[at][:, None] + span], common[at]
        differ = x != y
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        rows = np.flatnonzero(first < size)
        if (first != n).any() or (x[rows, first[rows]] > y[rows, first[rows]]).any():
            return False
    return True
