"""Suffix sorting and common extensions by prefix polynomial hashes, vectorised over many short texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240607)
#: One random 64-bit value per byte, and an odd base with its inverse: hashes are sums modulo 2**64.
VALUES = _RNG.integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_BLANK = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n, at least, of the base and of its inverse; the longest table so far is kept."""
    if len(_POWERS[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))]) for b in (BASE, INVERSE)]
    return _POWERS[0], _POWERS[1]


class Texts:
    """Many short byte strings as rows of a matrix, with the hash of every prefix; string ``i`` is ``raw[i, :length[i]]``."""

    def __init__(self, raw: np.ndarray, length: np.ndarray):
        self.raw, self.length = raw, length.astype(np.int64)
        up, self.down = powers(raw.shape[1])
        self.sums = np.zeros((len(raw), raw.shape[1] + 1), np.uint64)
        np.multiply(VALUES[raw], up[:raw.shape[1]], out=self.sums[:, 1:])
        np.cumsum(self.sums, axis=1, out=self.sums)
        self._flat, self._step = self.sums.reshape(-1), raw.shape[1] + 1

    @classmethod
    def of(cls, strings: list[bytes], back: bool = False) -> Texts:
        return cls.column(pa.array(strings, pa.large_binary()), back)

    @classmethod
    def column(cls, strings: pa.Array, back: bool = False) -> Texts:
        """From a binary column; with ``back`` every string is turned round."""
        strings = strings.cast(pa.large_binary())
        at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
        raw = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
        length = np.diff(at)
        k = np.arange(max(1, int(length.max(initial=0))))
        place = (at[1:, None] - 1 - k if back else at[:-1, None] + k)
        inside = k < length[:, None]
        out = raw[np.where(inside, place, 0)] if len(raw) else np.zeros(inside.shape, np.uint8)
        out[~inside] = 0
        return cls(out, length)

    def strings(self, back: bool = False) -> list[bytes]:
        made = [x[:n].tobytes() for x, n in zip(self.raw, self.length.tolist(), strict=True)]
        return [x[::-1] for x in made] if back else made

    def hashes(self, rows: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
        """Hash of ``length`` bytes of the rows' strings from ``start`` on, the same wherever the bytes stand."""
        at = rows * self._step + start
        return (self._flat[at + length] - self._flat[at]) * self.down[start]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of strings i and j: binary search on prefix hashes."""
        a, b = i * self._step, j * self._step
        low = np.zeros(len(i), np.int64)
        high = np.minimum(self.length[i], self.length[j])
        for _ in range(int(high.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self._flat[a + mid] == self._flat[b + mid]
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        return low

    def less(self, i: np.ndarray, j: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether string i sorts before j or, where ``equal``, is the same."""
        n = self.common(i, j)
        last = self.raw.shape[1] - 1
        x = np.where(n < self.length[i], self.raw[i, np.minimum(n, last)].astype(np.int64), -1)
        y = np.where(n < self.length[j], self.raw[j, np.minimum(n, last)].astype(np.int64), -1)
        return (x < y) | (equal & (x == y))

    def same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the first ``length`` bytes of strings i and j are the same, byte by byte."""
        out = np.empty(len(i), bool)
        k = np.arange(self.raw.shape[1])
        for lo in range(0, len(i), 4096):
            part = slice(lo, lo + 4096)
            out[part] = ((self.raw[i[part]] == self.raw[j[part]]) | (k >= length[part, None])).all(axis=1)
        return out

    def sort(self, group: np.ndarray) -> np.ndarray:
        """Order of all strings inside their groups (consecutive rows with one number): bottom-up mergesort by binary search.

        All groups are merged at once, each within itself. A comparison takes a logarithmic number
        of hash look-ups. Equal strings keep their order.
        """
        n = len(group)
        place = np.arange(n)
        if not n:
            return place
        first = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
        size = np.diff(first, append=n)
        begin, room = np.repeat(first, size), np.repeat(size, size)
        order, run = place.copy(), 1
        while run < size.max():
            k = (place - begin) // run
            left = k % 2 == 0
            other = begin + np.where(left, k + 1, k - 1) * run
            low = np.minimum(other, begin + room)
            high = np.minimum(low + run, begin + room)
            base = low.copy()
            todo = np.flatnonzero(low < high)
            while len(todo):
                mid = (low[todo] + high[todo]) >> 1
                # from the left run: others strictly less come before; from the right run: also equal ones
                before = self.less(order[mid], order[todo], ~left[todo])
                low[todo] = np.where(before, mid + 1, low[todo])
                high[todo] = np.where(before, high[todo], mid)
                todo = todo[low[todo] < high[todo]]
            target = begin + (k // 2) * 2 * run + (place - begin - k * run) + (low - base)
            merged = np.empty(n, np.int64)
            merged[target] = order
            order, run = merged, run * 2
        return order


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) over every ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = of(x[:-have], x[have:])
        have *= 2
    return of(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _least(h: np.ndarray, count: int) -> np.ndarray:
    """Places whose value is the least of some ``count`` neighbours."""
    least = _sliding(h, count, np.minimum)
    edge = np.zeros(count - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), count, np.maximum) == h)


def anchors(data: bytes, length: int, width: int, segment: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose ``width`` bytes hash least in some window of ``length`` bytes, and these hashes.

    The choice depends on the window's bytes alone, so equal windows have equal anchors, and every
    window has one. Long texts are taken in segments.
    """
    n, back = len(data), length - width
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    raw = np.frombuffer(data, np.uint8)
    made = []
    for lo in range(0, n - length + 1, segment):
        hi = min(n, lo + segment + length - 1)
        part = raw[lo:hi]
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUES[part] * up[:len(part)], out=sums[1:])
        h = _scramble((sums[width:] - sums[:-width]) * down[:len(part) + 1 - width])
        chosen = _least(h, back + 1)
        made.append((chosen + lo, h[chosen]))
    if len(made) == 1:
        return made[0]
    places, hashes = (np.concatenate(x) for x in zip(*made, strict=True))
    places, one = np.unique(places, return_index=True)
    return places, hashes[one]


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word, a run of bytes other than ASCII white space, starts and ends."""
    inside = np.concatenate([[False], ~_BLANK[np.frombuffer(data, np.uint8)], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def _word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, segment: int = 1 << 20) -> np.ndarray:
    """A hash of each word's bytes, from BLAKE2 for words of over 512 bytes; long texts are taken in segments."""
    raw = np.frombuffer(data, np.uint8)
    out = np.empty(len(starts), np.uint64)
    short = ends - starts <= 512
    at, end = starts[short], ends[short]
    made = np.empty(len(at), np.uint64)
    first = np.flatnonzero(np.diff(at // segment, prepend=-1)).tolist()
    for i, j in zip(first, [*first[1:], len(at)], strict=True):
        lo = int(at[i])
        part = raw[lo:int(end[j - 1])]
        up, down = powers(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUES[part] * up[:len(part)], out=sums[1:])
        a, b = at[i:j] - lo, end[i:j] - lo
        made[i:j] = (sums[b] - sums[a]) * down[a]
    out[short] = made
    for k in np.flatnonzero(~short).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k]:ends[k]], digest_size=8).digest(), "little")
    return _scramble(out)


def word_anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words whose ``width`` words hash least in some window of ``length`` words, these hashes, and that of a window around each.

    As with ``anchors`` equal windows have equal anchors. The window around an anchor has ``length`` words too: as many before
    the anchor's words as after them, but where the text ends.
    """
    n = len(starts)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_word_hashes(data, starts, ends) * up[:n], out=sums[1:])
    h = _scramble((sums[width:] - sums[:-width]) * down[:n + 1 - width])
    chosen = _least(h, length - width + 1)
    at = np.clip(chosen - (length - width) // 2, 0, n - length)
    return chosen, h[chosen], _scramble((sums[at + length] - sums[at]) * down[at])


def extents(left: Texts, right: Texts, group: np.ndarray, length: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per row, how far matches of at least ``length`` bytes reach left and right of its anchor (0, 0: none).

    Row i matches row j of its group over ``L + R`` bytes, the common prefix of the left contexts
    (which are turned round) and that of the right ones. Rows are suffix-sorted both ways; neighbours
    in sorted order have the longest extensions, so each row looks outwards until a neighbour
    qualifies or none can. Every match is checked on its bytes; a group in which one fails (its hashes
    collide) is settled window by window. Only ``wanted`` rows are looked up (default: all); the
    others are there to be found. Rows of a group are consecutive.
    """
    n = len(group)
    sides = (left, right)
    orders = [t.sort(group) for t in sides]
    rank, near = [], []
    for t, order in zip(sides, orders, strict=True):
        r = np.empty(n, np.int64)
        r[order] = np.arange(n)
        lcp = np.zeros(n + 1, np.int64)  # of the sorted neighbours k - 1 and k; 0 at the ends and between groups
        if n > 1:
            a, b = order[:-1], order[1:]
            lcp[1:n] = np.where(group[a] == group[b], t.common(a, b), 0)
        rank.append(r)
        near.append(lcp)
    most = [np.maximum(lcp[r], lcp[r + 1]) for r, lcp in zip(rank, near, strict=True)]
    possible = most[0] + most[1] >= length
    if wanted is not None:
        possible &= wanted
    reach = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    failed = np.zeros(n, bool)
    for side in (0, 1):
        order, lcp = orders[side], near[side]
        for direction in (-1, 1):
            i = np.flatnonzero(possible)
            at = rank[side][i]
            low = np.full(len(i), 1 << 40)
            while len(i):
                low = np.minimum(low, lcp[at + (direction > 0)])
                at = at + direction
                # stops: group's end (extension 0), nothing better than known, or the rest cannot make up the length
                go = (low > reach[side][i]) & (low + most[1 - side][i] >= length) & (at >= 0) & (at < n)
                i, at, low = i[go], at[go], low[go]
                j = order[at]
                far = sides[1 - side].common(i, j)
                hit = low + far >= length
                if hit.any():
                    k, m, a, b = i[hit], j[hit], low[hit], far[hit]
                    good = sides[side].same(k, m, a) & sides[1 - side].same(k, m, b)
                    failed[k[~good]] = True
                    reach[side][k] = np.maximum(reach[side][k], a)
                    i, at, low = i[~hit], at[~hit], low[~hit]
    for g in np.unique(group[failed]):
        rows = np.flatnonzero(group == g)
        before, after = left.strings(back=True), right.strings()
        reach[0][rows], reach[1][rows] = by_windows([before[k] for k in rows], [after[k] for k in rows], length)
    none = (reach[0] == 0) & (reach[1] == 0)
    return np.where(none, 0, reach[0]), np.where(none, 0, reach[1])


def by_windows(lefts: list[bytes], rights: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """``extents`` of one group by comparing, for each offset, the windows' bytes themselves."""
    n = len(lefts)
    high, low = np.full(n, -1), np.full(n, length + 1)
    for d in range(length + 1):
        seen: dict[bytes, int] = {}
        for i in range(n):
            if d <= len(lefts[i]) and length - d <= len(rights[i]):
                window = lefts[i][len(lefts[i]) - d:] + rights[i][:length - d]
                j = seen.setdefault(window, i)
                if j != i:
                    high[[i, j]] = d
                    low[[i, j]] = np.minimum(low[[i, j]], d)
    found = high >= 0
    return np.where(found, high, 0), np.where(found, length - low, 0)
