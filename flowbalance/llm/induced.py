"""Repeats of a text by external induced sorting.

Suffixes get their order from the order of those that follow them: the left-most smaller ones are sorted
by names, by recursion on the names if these repeat; a pass in increasing order induces the larger ones
and a pass in decreasing order the smaller ones. Each pass takes suffix tuples from a priority queue
whose keys only grow (or only shrink), so tuples of one key leave it in the order they came. The queues
keep what exceeds their memory in an unlinked file that ends with the task.

On the text itself the passes work on blocks of tuples and carry the length of the common prefix with
the tuple before, capped: an induced suffix shares one symbol more with the one pushed before it to the same
key than the least of the prefixes in between. In the recursion, where keys are names, tuples go one by one.
"""

from __future__ import annotations

import tempfile
from array import array

import numpy as np

#: Tuples that a queue holds in memory.
IN_MEMORY = 1 << 20
BLOCK = 1 << 14


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last symbol is the smallest and alone."""
    step = np.sign(np.diff(t.astype(np.int64)))
    at = np.where(step != 0, np.arange(len(step)), len(step))
    ahead = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, -1)[ahead] > 0, True)


def name_substrings(t: np.ndarray, smaller: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Dense order-preserving names of the substrings from each start to the next (it included)."""
    typed = t.astype(np.uint64) * np.uint64(2) + smaller + np.uint64(1)
    bits = int(typed.max()).bit_length()
    per = max(1, 63 // bits)
    size = np.append(np.diff(starts) + 1, 1)
    names = np.zeros(len(starts), np.int64)
    active = np.arange(len(starts))
    at = 0
    while len(active):
        word = np.zeros(len(active), np.uint64)
        for k in range(at, at + per):
            inside = size[active] > k
            word = (word << np.uint64(bits)) | np.where(inside, typed[np.minimum(starts[active] + k, len(t) - 1)], np.uint64(0))
        # within a group of equal names so far, order by the next word
        order = np.lexsort((word, names[active]))
        group, sorted_word = names[active][order], word[order]
        first = np.append(True, group[1:] != group[:-1])
        fresh = first | np.append(True, sorted_word[1:] != sorted_word[:-1])
        place = np.arange(len(order))
        lead = np.maximum.accumulate(np.where(first, place, 0))
        names[active[order]] = group + np.maximum.accumulate(np.where(fresh, place, 0)) - lead
        alone = fresh & np.append(fresh[1:], True)
        active = np.sort(active[order[~alone]])
        at += per
        active = active[size[active] > at]
    _, dense = np.unique(names, return_inverse=True)
    return dense


class KeyQueue:
    """Priority queue of integers by integer keys that are taken in one direction.

    Keys are dealt into ranges, one if all fits into memory. The range being taken is ``near``, a list
    for each key; others are lists of (key, item), written to a file when the queue holds more
    than ``limit`` items.
    """

    def __init__(self, keys: int, items: int, limit: int = IN_MEMORY, ranges: int = 64):
        ranges = 1 if items <= limit else ranges
        self.width = max(1, -(-keys // ranges))
        self.far: list[list[int]] = [[] for _ in range(-(-keys // self.width))]
        self.spilled: list[list[tuple[int, int]]] = [[] for _ in self.far]
        self.held, self.limit, self.file = 0, limit, None

    def push(self, key: int, item: int) -> None:
        """For a key of a range yet to be taken."""
        self.far[key // self.width] += (key, item)
        self.held += 1
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for r, items in enumerate(self.far):
            if items:
                self.spilled[r].append((self.file.tell(), len(items)))
                array("q", items).tofile(self.file)
                items.clear()
        self.held = 0

    def take(self, r: int) -> list[list[int]]:
        """The range's items by key. A list grows as its key is pushed while the range is taken."""
        items = array("q")
        for at, n in self.spilled[r]:
            self.file.seek(at)
            items.fromfile(self.file, n)
        items.extend(self.far[r])
        self.held -= len(self.far[r]) // 2
        self.far[r], self.spilled[r] = [], []
        low, near = r * self.width, [[] for _ in range(self.width)]
        for k in range(0, len(items), 2):
            near[items[k] - low].append(items[k + 1])
        return near


def sorted_suffixes(t: np.ndarray, limit: int = IN_MEMORY) -> np.ndarray:
    """Suffix array of dense names whose last one, 0, occurs nowhere else."""
    keys = int(t.max()) + 1
    if keys == len(t):
        return np.argsort(t)
    smaller = suffix_types(t)
    stars = np.flatnonzero(smaller & np.append(True, ~smaller[:-1]))
    stars = stars[stars > 0]
    ranked = stars[_order(name_substrings(t, smaller, stars), limit)]
    bounds = np.searchsorted(t[ranked], np.arange(keys + 1)).tolist()
    stars = (ranked - 1).tolist()  # the larger ones before them
    before = [-1, *t.tolist()]  # name before each suffix; none is a key before the first
    queue, ends, larger = KeyQueue(keys, len(t), limit), [0], array("q")
    width = queue.width
    for low in range(0, keys, width):
        near = queue.take(low // width)
        high = low + width
        for c in range(low, min(high, keys)):
            items = near[c - low]
            for p in items:
                q = before[p]
                if q >= c:
                    if q < high:
                        near[q - low].append(p - 1)
                    else:
                        queue.push(q, p - 1)
            for p in stars[bounds[c]:bounds[c + 1]]:
                q = before[p + 1]
                if q < high:
                    near[q - low].append(p)
                else:
                    queue.push(q, p)
            if items:
                larger.extend(items)
            ends.append(len(larger))
    before[0] = keys
    queue, parts = KeyQueue(keys, len(t), limit), []
    queue.push(0, len(t) - 1)
    for low in range((keys - 1) // width * width, -1, -width):
        near = queue.take(low // width)
        for c in range(min(low + width, keys) - 1, low - 1, -1):
            items = near[c - low]
            for p in items:
                q = before[p]
                if q <= c:
                    if q >= low:
                        near[q - low].append(p - 1)
                    else:
                        queue.push(q, p - 1)
            ups = larger[ends[c]:ends[c + 1]]
            for p in reversed(ups):
                q = before[p]
                if q < c:
                    if q >= low:
                        near[q - low].append(p - 1)
                    else:
                        queue.push(q, p - 1)
            parts += (items, ups)
    out = array("q")
    for k in range(len(parts) - 1, 0, -2):
        if parts[k]:
            out.extend(parts[k])
        if parts[k - 1]:
            out.extend(parts[k - 1][::-1])
    return np.frombuffer(out, np.int64)


def _order(names: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes of a string of names; its last name is the smallest and alone."""
    return sorted_suffixes(names, limit)


class BlockQueue:
    """Priority queue of (position, prefix) tuples by symbol, in arrays; beyond ``limit`` on disk."""

    def __init__(self, keys: int, limit: int):
        self.parts: list[list] = [[] for _ in range(keys)]
        self.held, self.limit, self.file = 0, limit, None

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.parts[key].append((pos, lcp))
        self.held += len(pos)
        if self.held > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            for parts in self.parts:
                for k, part in enumerate(parts):
                    if isinstance(part[0], np.ndarray):
                        parts[k] = (self.file.tell(), len(part[0]))
                        self.file.write(part[0].astype(np.int64).tobytes() + part[1].astype(np.int16).tobytes())
            self.held = 0

    def take(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """What was pushed for the key since it was last taken."""
        pos, lcp = [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]
        for part in self.parts[key]:
            if isinstance(part[0], np.ndarray):
                self.held -= len(part[0])
            else:
                self.file.seek(part[0])
                part = (np.frombuffer(self.file.read(8 * part[1]), np.int64), np.frombuffer(self.file.read(2 * part[1]), np.int16))
            pos.append(part[0])
            lcp.append(part[1])
        self.parts[key] = []
        return np.concatenate(pos), np.concatenate(lcp)


class _Inducer:
    """One pass: tuples come in order, and those of the suffixes before them go to the queue."""

    def __init__(self, t: np.ndarray, cap: int, limit: int):
        self.t, self.cap, self.keys = t, cap, int(t.max()) + 1
        self.queue = BlockQueue(self.keys, limit)
        self.least = np.zeros(self.keys, np.int16)  # of the prefixes since the last push to each key

    def feed(self, pos: np.ndarray, lcp: np.ndarray, low: int, high: int) -> None:
        """Tuples next in order; pushes those whose preceding symbol is from low to high."""
        for at in range(0, len(pos), BLOCK):
            self._block(pos[at:at + BLOCK], lcp[at:at + BLOCK], low, high)

    def _block(self, pos: np.ndarray, lcp: np.ndarray, low: int, high: int) -> None:
        before = np.where(pos > 0, self.t[np.maximum(pos, 1) - 1].astype(np.int64), -1)
        go = np.flatnonzero((before >= low) & (before <= high))
        n = len(pos)
        if len(go):
            key = before[go]
            order = np.argsort(key, kind="stable")
            go, key = go[order], key[order]
            first = np.append(True, key[1:] != key[:-1])
            begin = np.where(first, 0, np.append(0, go[:-1] + 1))
            share = _range_least(lcp, begin, go)
            share = np.where(first, np.minimum(share, self.least[key]), share)
            share = np.minimum(share + 1, self.cap).astype(np.int16)
            heads = np.flatnonzero(first)
            for a, b in zip(heads, [*heads[1:], len(go)], strict=True):
                self.queue.push(int(key[a]), pos[go[a:b]] - 1, share[a:b])
            lasts = np.append(heads[1:], len(go)) - 1
            self.least = np.minimum(self.least, lcp.min())
            rest = np.append(np.minimum.accumulate(lcp[::-1])[::-1], self.cap)
            self.least[key[lasts]] = rest[go[lasts] + 1]
        elif n:
            self.least = np.minimum(self.least, lcp.min())


def _range_least(x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least of x[begin..end], end included, by a table of spans of powers of two."""
    level = np.frexp((end - begin + 1).astype(np.float64))[1] - 1
    out = np.empty(len(begin), x.dtype)
    table, k = x, 0
    while True:
        here = np.flatnonzero(level == k)
        if len(here):
            out[here] = np.minimum(table[begin[here]], table[end[here] + 1 - (1 << k)])
        k += 1
        if (1 << k) > len(x) or k > level.max():
            return out
        table = np.minimum(table[:-(1 << (k - 1))], table[1 << (k - 1):])


def _words(t: np.ndarray) -> tuple[np.ndarray, int]:
    """From each position the next symbols as one integer (zeros beyond the end), and the bits of a symbol."""
    kind = "<u1" if t.dtype.itemsize == 1 else "<u2"
    size = np.dtype(kind).itemsize
    padded = np.append(t.astype(kind), np.zeros(8 // size, kind))
    return np.ndarray((len(t) + 1,), "<u8", padded, strides=(size,)), 8 * size


def _common(words: tuple[np.ndarray, int], a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffix pairs, up to cap symbols, a word at a time."""
    wide, bits = words
    out = np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    last = len(wide) - 1
    while len(active):
        x = wide[np.minimum(a[active] + out[active], last)] ^ wide[np.minimum(b[active] + out[active], last)]
        same = x == 0
        lowest = np.frexp((x & (~x + np.uint64(1))).astype(np.float64))[1] - 1
        out[active] += np.where(same, 64 // bits, lowest // bits)
        active = active[same & (out[active] < cap)]
    return np.minimum(out, cap).astype(np.int16)


def repeated(t: np.ndarray, length: int, limit: int = IN_MEMORY) -> np.ndarray:
    """True at each position whose next ``length`` symbols also start at another position.

    t holds small non-negative integers; its last symbol, 0, occurs nowhere else.
    """
    hit = np.zeros(len(t), bool)
    if len(t) < 2:
        return hit
    smaller = suffix_types(t)
    stars = np.flatnonzero(smaller & np.append(True, ~smaller[:-1]))
    stars = stars[stars > 0]
    ranked = stars[_order(name_substrings(t, smaller, stars), limit)]
    words = _words(t)
    star_lcp = np.append(np.int16(0), _common(words, ranked[:-1], ranked[1:], length))
    keys = int(t.max()) + 1
    bounds = np.searchsorted(t[ranked], np.arange(keys + 1))

    def mark(pos: np.ndarray, lcp: np.ndarray) -> None:
        """lcp is with the tuple before."""
        at = np.flatnonzero(lcp >= length)
        at = at[at > 0]
        hit[pos[at]] = True
        hit[pos[at - 1]] = True

    up = _Inducer(t, length, limit)
    larger: list[tuple[np.ndarray, np.ndarray]] = []
    kept = BlockQueue(keys, limit)
    for c in range(keys):
        pos, lcp = [], []
        while True:
            p, n = up.queue.take(c)
            if not len(p):
                break
            if not pos:
                n = n.copy()
                n[0] = 0  # the bucket before has another first symbol
            pos.append(p)
            lcp.append(n)
            up.feed(p, n, c, keys - 1)
        star = ranked[bounds[c]:bounds[c + 1]]
        if pos:
            pos, lcp = np.concatenate(pos), np.concatenate(lcp)
            mark(pos, lcp)
            kept.push(c, pos, lcp)
        if len(star):
            own = star_lcp[bounds[c]:bounds[c + 1]].copy()
            own[0] = _common(words, pos[-1:], star[:1], length)[0] if len(pos) else 0
            up.feed(star, own, c + 1, keys - 1)
    down = _Inducer(t, length, limit)
    for c in range(keys - 1, -1, -1):
        if c == 0:
            down.queue.push(0, np.array([len(t) - 1]), np.zeros(1, np.int16))
        pos, lcp = [], []
        while True:
            p, n = down.queue.take(c)
            if not len(p):
                break
            if not pos:
                n = n.copy()
                n[0] = 0
            pos.append(p)
            lcp.append(n)
            down.feed(p, n, 0, c)
        p, n = kept.take(c)
        if pos:
            pos, lcp = np.concatenate(pos), np.concatenate(lcp)
            mark(pos, lcp)
        if len(p):
            p, n = p[::-1], np.append(np.int16(0), n[:0:-1])
            if len(pos):
                n[0] = seam = _common(words, p[:1], pos[-1:], length)[0]
                if seam >= length:
                    hit[p[0]] = hit[pos[-1]] = True
            down.feed(p, n, 0, c - 1)
    return hit
