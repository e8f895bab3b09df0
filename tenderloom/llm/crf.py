"""Linear-chain conditional random field over word shapes, in numpy.

A token has one code for each feature template; its score for a label is the sum of a weight
for each code, and neighbouring labels add a transition weight.  Training follows the exact
gradient of the conditional likelihood (forward-backward); decoding is Viterbi.  Both run over
batches of padded sequences.
"""

from __future__ import annotations

import numpy as np

_NONE = -1e30


def padded(sequences: list[np.ndarray], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sequences of one batch as an array, and their lengths."""
    length = np.array([len(s) for s in sequences], np.int64)
    out = np.full((len(sequences), int(length.max(initial=1)), *sequences[0].shape[1:]), fill, np.int64)
    for i, s in enumerate(sequences):
        out[i, : len(s)] = s
    return out, length


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Crf:
    def __init__(self, n_codes: int, n_labels: int):
        self.emit = np.zeros((n_codes, n_labels))
        self.move = np.zeros((n_labels, n_labels))

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Template by template, so that only one score for each label and token is held."""
        out = self.emit[codes[..., 0]]
        for k in range(1, codes.shape[-1]):
            out += self.emit[codes[..., k]]
        return out

    def fit(self, codes: list[np.ndarray], labels: list[np.ndarray], rounds: int = 300, ridge: float = 0.02) -> None:
        x, n = padded(codes)
        y, _ = padded(labels)
        size, long = y.shape
        inside = np.arange(long) < n[:, None]
        n_labels = self.move.shape[0]
        truth = np.eye(n_labels)[y] * inside[..., None]
        pair_truth = np.einsum("bti,btj->ij", truth[:, :-1], truth[:, 1:])
        state = [[np.zeros_like(p) for p in (self.emit, self.move)] for _ in range(2)]
        for step in range(1, rounds + 1):
            score = self.scores(x)
            ahead, back = np.empty_like(score), np.zeros_like(score)
            ahead[:, 0] = score[:, 0]
            for t in range(1, long):
                new = _log_sum(ahead[:, t - 1, :, None] + self.move, 1) + score[:, t]
                ahead[:, t] = np.where(inside[:, t, None], new, ahead[:, t - 1])
            total = _log_sum(ahead[:, -1], 1)
            for t in range(long - 2, -1, -1):
                new = _log_sum(self.move + (score[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(inside[:, t + 1, None], new, 0.0)
            chance = np.exp(ahead + back - total[:, None, None]) * inside[..., None]
            pair = np.exp(
                ahead[:, :-1, :, None] + self.move + (score + back)[:, 1:, None, :] - total[:, None, None, None]
            )
            pair = (pair * inside[:, 1:, None, None]).sum(axis=(0, 1))
            grad_emit = np.zeros_like(self.emit)
            gap = (chance - truth)[inside]
            for k in range(x.shape[2]):
                np.add.at(grad_emit, x[..., k][inside], gap)
            grads = (grad_emit / size + ridge * self.emit / size, (pair - pair_truth) / size + ridge * self.move / size)
            for i, (p, g) in enumerate(zip((self.emit, self.move), grads, strict=True)):
                first, second = state[0], state[1]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                p -= 0.1 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)

    def decode(self, codes: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sequence."""
        if not codes:
            return []
        x, n = padded(codes)
        score = self.scores(x)
        size, long, n_labels = score.shape
        best, came = score[:, 0].copy(), np.zeros((size, long, n_labels), np.int8)
        last = np.where(n[:, None] == 1, best, _NONE)
        for t in range(1, long):
            step = best[:, :, None] + self.move
            came[:, t] = step.argmax(axis=1)
            best = step.max(axis=1) + score[:, t]
            last = np.where(n[:, None] == t + 1, best, last)
        out = np.zeros((size, long), np.int8)
        label, rows = last.argmax(axis=1), np.arange(size)
        for t in range(long - 1, -1, -1):
            here = t < n
            out[here, t] = label[here]
            if t:
                label = np.where(here, came[rows, t, label], label)
        return [out[i, : n[i]] for i in range(size)]
