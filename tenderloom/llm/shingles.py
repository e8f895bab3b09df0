"""Weighted word shingles of many texts at once, as 64-bit numbers, in numpy."""

from __future__ import annotations

import numpy as np

from tenderloom.llm.decontaminate import normal_bytes

WORDS = 5

_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each number (the finisher of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: str | None) -> bytes:
    """Lower-cased words, one blank apart."""
    return b" ".join(normal_bytes((text or "").lower()).split())


def word_numbers(joined: bytes) -> np.ndarray:
    """A number for each word of blank-separated bytes; equal words have equal numbers."""
    raw = np.frombuffer(joined, np.uint8)
    inside = raw != 32
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE))  # modulo 2**64
    value = (raw[starts[0] :] + np.uint64(1)) * powers[place]
    value[~inside[starts[0] :]] = 0
    return mix(np.add.reduceat(value, starts - starts[0]))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, counts, shingles of each text): the distinct shingles of each normal text in
    order, with how often each occurs.  A text of fewer words, but not none, is one shingle."""
    numbers = word_numbers(b" ".join(texts))
    n = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    kept = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(texts)), kept)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(kept) - kept, kept)
    padded = np.concatenate((numbers, np.zeros(words, np.uint64)))
    value = np.zeros(len(owner), np.uint64)
    left = (first + n)[owner] - at  # words of the text from here on
    for k in range(words):
        value = value * _BASE + np.where(left > k, padded[at + k], np.uint64(0))
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    counts = np.diff(np.append(begin, len(value)))
    return value[begin], counts, np.bincount(owner[begin], minlength=len(texts))
