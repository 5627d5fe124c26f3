"""Words and word shingles of whole texts as 64-bit hashes, computed on blocks of bytes."""

from __future__ import annotations

import numpy as np

from flowbalance.llm.common import LOWER, UPPER, keyed, mixed

_CODES = keyed(256, 4)
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[list(UPPER.encode())] = list(LOWER.encode())
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd, so it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done:done + more] = out[:more] * step
        done += more
    return out[:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, index of each text's first word and the end).

    Words are runs of anything but white space, with A-Z lower-cased; none crosses texts.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    starts_at = np.zeros(n, bool)
    starts_at[offsets[:-1][np.diff(offsets) > 0]] = True  # first bytes of texts
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | starts_at[1:]
    begin = np.flatnonzero(begins)
    last = inside.copy()
    last[:-1] &= ~inside[1:] | starts_at[1:]
    end = np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[_LOWERED[data]] * powers(_BASE, n), out=total[1:])
    hashes = (total[end] - total[begin]) * powers(_BACK, n)[begin]
    return mixed(hashes + (end - begin).astype(np.uint64)), np.searchsorted(begin, offsets)


def shingles(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` words, index of each text's first run and the end). A text of
    fewer words is one run; one without words has none. Equal runs aren't merged."""
    count = np.diff(first)
    runs = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    of = np.concatenate(([0], np.cumsum(runs)))
    text = np.repeat(np.arange(len(count)), runs)
    begin = first[:-1][text] + (np.arange(of[-1]) - of[:-1][text])
    used = np.minimum(count[text], width)
    out = np.zeros(len(begin), np.uint64)
    factor = keyed(width, 44) | np.uint64(1)
    padded = np.append(words, np.zeros(width, np.uint64))
    for k in range(width):
        out += np.where(k < used, padded[begin + k] * factor[k], np.uint64(0))
    return mixed(out + used.astype(np.uint64)), of
