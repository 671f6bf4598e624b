"""Small learners whose input is bounded: vote patterns with counts, and a sample of hashed feature rows."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Votes:
    """Dawid-Skene model of labellers that vote +1, -1 or 0 (abstain) on a two-valued truth.

    Expectation-maximisation over distinct vote patterns with their counts gives
    the same estimates as over all rows, in memory that the number of labellers
    bounds. It starts from the majority, a vote against counting ``against``
    times, and holds every labeller to be no worse than chance: a vote can't
    speak for its opposite, so the classes can't change places. Once
    the odds are estimated, an abstention speaks for neither. ``prior`` votes are added to each labeller's counts.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, share: float = 0.5, prior: float = 2.0, against: float = 3.0, least: float = 0.0, rounds: int = 200):
        m, self.least = patterns.shape[1], least
        self.share, self.odds = share, np.zeros((m, 3))
        p = sigmoid(np.where(patterns < 0, against * patterns, patterns).sum(1))
        hit = np.stack([patterns == v for v in (-1, 0, 1)], 2)  # pattern, labeller, vote
        if not len(counts):
            return
        for _ in range(rounds):
            rate = []
            for q, right in ((p, (0.5, 1, 1.5)), (1 - p, (1.5, 1, 0.5))):
                n = np.tensordot(counts * q, hit, 1) + prior * np.array(right) / 3
                rate.append(n / n.sum(1, keepdims=True))
            self.odds = np.log(rate[0] / rate[1])
            self.odds[:, 0], self.odds[:, 2] = np.minimum(self.odds[:, 0], -self.least), np.maximum(self.odds[:, 2], 0)
            self.share = float(np.clip((counts * p).sum() / counts.sum(), 1e-4, 1 - 1e-4))
            new = self.posterior(patterns)
            if np.abs(new - p).max() < 1e-7:
                break
            p = new
        self.odds[:, 1] = 0

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability that the truth is +1."""
        at = np.asarray(patterns, int) + 1
        return sigmoid(np.log(self.share / (1 - self.share)) + self.odds[np.arange(self.odds.shape[0]), at].sum(-1))


def pairs_of(rows: np.ndarray, slots: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, slot) with counts, from unsorted occurrences."""
    code, n = np.unique(rows * width + slots, return_counts=True)
    return code // width, code % width, n


def fit_linear(row: np.ndarray, slot: np.ndarray, value: np.ndarray, slope, width: int, rounds: int, rate: float, decay: float = 1e-4) -> np.ndarray:
    """Full-batch AdaGrad for a linear score; ``slope(scores)`` is the log-likelihood's derivative at each row's score."""
    w, seen = np.zeros(width), np.full(width, 1e-6)
    n = int(row.max()) + 1 if len(row) else 0
    for _ in range(rounds):
        g = np.bincount(slot, value * slope(np.bincount(row, value * w[slot], n))[row], width) / max(n, 1) - decay * w
        seen += g * g
        w += rate * g / np.sqrt(seen)
    return w
