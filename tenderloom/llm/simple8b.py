"""Simple-8b coding of unsigned ids in numpy.

A 64-bit word holds a selector in its top four bits and as many ids of one width as fit in the
other 60.  Ids are coded in blocks of ``BLOCK``, which all advance at once; the word offset of each
block allows reading it alone.  An id of more than 60 bits is escaped: its word holds the place
of the id in a table of escapes.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024

# Fixed values: (ids in a word, bits of each) by selector.  Selector 0 is the escape; 1 is a run of 120 zeros.
SELECTORS = (
    (1, 60), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)
_COUNTS = np.array([n for n, _ in SELECTORS], np.int64)
_ESCAPE, _FOUR = 0, np.uint64(60)


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For every position, the selector of the most ids that fit in a word starting there and in its block."""
    n = len(ids)
    best = np.full(n, 15, np.int8)
    best[ids >= np.uint64(1 << 60)] = _ESCAPE
    left = np.minimum(n - np.arange(n), BLOCK - np.arange(n) % BLOCK)
    at = np.arange(n)
    # More ids at fewer bits fit only where fewer ids at more bits do, so the candidates shrink.
    for selector in range(14, 0, -1):
        count, bits = SELECTORS[selector]
        wide = np.concatenate(([0], np.cumsum(ids >= np.uint64(1 << bits), dtype=np.int32)))
        at = at[left[at] >= count]
        at = at[wide[at + count] == wide[at]]
        if not len(at):
            break
        best[at] = selector
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block, and the table of escaped ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    best = _selectors(ids)
    step = _COUNTS[best]
    first = np.arange(0, n, BLOCK)
    end = np.minimum(first + BLOCK, n)
    pos, live, taken = first.copy(), np.arange(len(first)), []
    while len(live):  # each round takes one word of every block that is not done
        taken.append(pos[live])
        pos[live] += step[pos[live]]
        live = live[pos[live] < end[live]]
    starts = np.sort(np.concatenate(taken))
    chosen = best[starts]
    words = chosen.astype(np.uint64) << _FOUR
    for selector in np.unique(chosen):
        count, bits = SELECTORS[selector]
        if selector == _ESCAPE or not bits:
            continue
        own = np.flatnonzero(chosen == selector)
        for k in range(count):
            words[own] |= ids[starts[own] + k] << np.uint64(k * bits)
    escaped = np.flatnonzero(chosen == _ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    return words, np.searchsorted(starts, first).astype(np.uint32), ids[starts[escaped]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of consecutive words."""
    chosen = (words >> _FOUR).astype(np.int8)
    step = _COUNTS[chosen]
    ends = np.cumsum(step)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - step
    for selector in np.unique(chosen):
        count, bits = SELECTORS[selector]
        own = np.flatnonzero(chosen == selector)
        if selector == _ESCAPE:
            out[starts[own]] = escapes[(words[own] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                out[starts[own] + k] = (words[own] >> np.uint64(k * bits)) & mask
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, block: int) -> np.ndarray:
    """One block alone."""
    end = offsets[block + 1] if block + 1 < len(offsets) else len(words)
    return decode(words[offsets[block] : end], escapes)
