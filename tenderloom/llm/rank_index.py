"""A learned rank index: boundary offsets of token ranks by piecewise-linear segments.

The offsets b(0) <= ... <= b(n) of a text's token boundaries are covered by segments.  A segment
predicts b(k) on the straight line, in integers, between its first and last boundary and is used
only where all its predictions are within ``ERROR`` of the truth; the difference, the residual, is
stored in one byte for each rank.  A look-up finds the segment of a rank by binary search, predicts
and adds the residual, so it is exact.

All texts of a batch are fitted together: every open segment is tested against its line at once,
those beyond the bound are halved, and a segment of two boundaries has no error, so there are at
most log2 of the longest text rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ERROR = 127


def _lines(rank: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low + (rank - first) * (high - low) // np.maximum(last - first, 1)


@dataclass
class RankIndex:
    """Segments over the concatenated ranks of several texts, in order."""

    first: np.ndarray  # first rank of each segment, ascending
    last: np.ndarray  # its last rank
    low: np.ndarray  # offset of the first
    high: np.ndarray  # and of the last
    residual: np.ndarray  # int8, of every rank

    @classmethod
    def fit(cls, offsets: np.ndarray, starts: np.ndarray) -> RankIndex:
        """``starts``: the place in ``offsets`` where each text begins; every text has a boundary."""
        first, last = starts.astype(np.int64), np.append(starts[1:], len(offsets)).astype(np.int64) - 1
        residual = np.zeros(len(offsets), np.int8)
        done = []
        while len(first):
            n = last - first + 1
            begin = np.cumsum(n) - n
            rank = np.repeat(first - begin, n) + np.arange(int(n.sum()))
            line = _lines(rank, *(np.repeat(x, n) for x in (first, last, offsets[first], offsets[last])))
            gap = offsets[rank] - line
            good = np.maximum.reduceat(np.abs(gap), begin) <= ERROR
            inside = np.repeat(good, n)
            residual[rank[inside]] = gap[inside]
            done.append(np.stack((first[good], last[good])))
            first, last = first[~good], last[~good]
            middle = (first + last) // 2
            first, last = np.concatenate((first, middle + 1)), np.concatenate((middle, last))
        found = np.concatenate(done, axis=1) if done else np.zeros((2, 0), np.int64)
        first, last = found[:, np.argsort(found[0], kind="stable")]
        return cls(first, last, offsets[first], offsets[last], residual)

    def offset(self, rank: np.ndarray) -> np.ndarray:
        """Exact offsets of ranks."""
        s = np.searchsorted(self.first, rank, side="right") - 1
        return _lines(rank, self.first[s], self.last[s], self.low[s], self.high[s]) + self.residual[rank]
