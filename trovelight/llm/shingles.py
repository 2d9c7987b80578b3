"""Word shingles of whole texts and their ProbMinHash signatures, vectorised over a text's bytes."""

from __future__ import annotations

import numpy as np

# Odd 64-bit numbers of the splitmix64 generator.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x100000001B3)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers to well spread ones, one to one."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Shingles of `size` words; keeps the powers that hash words."""

    def __init__(self, size: int = 5) -> None:
        self.size = size
        self.powers = np.cumprod(np.full(64, _BASE))

    def words(self, text: bytes) -> np.ndarray:
        """A hash of every run of `[^\\x20\\x09-\\x0D]`."""
        letters = np.frombuffer(text, np.uint8)
        at = np.flatnonzero(~_IS_SPACE[letters])
        if not len(at):
            return np.empty(0, np.uint64)
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        lengths = np.diff(starts, append=len(at))
        longest = int(lengths.max())
        if longest > len(self.powers):
            self.powers = np.cumprod(np.full(2 * longest, _BASE))
        place = np.arange(len(at)) - np.repeat(starts, lengths)
        return mixed(np.add.reduceat((letters[at].astype(np.uint64) + np.uint64(1)) * self.powers[place], starts))

    def every(self, text: bytes) -> np.ndarray:
        """The shingles one after the other. A text of fewer words is one shingle, a text of none has none."""
        words = self.words(text)
        if not len(words):
            return words
        size = min(self.size, len(words))
        total = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            total = (total + words[i : i + len(total)]) * _STEP
        return mixed(total)

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The distinct shingles in order, and how often each occurs."""
        return np.unique(self.every(text), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    """A shingle's weight grows with the logarithm of its count, so that a repeated line does not outweigh a text."""
    return 1.0 + np.log(counts)


def signature(shingles: np.ndarray, weight: np.ndarray, places: int) -> np.ndarray:
    """ProbMinHash: at each of `places` places the shingle that arrives there first.

    Every shingle sends arrivals at the times of a Poisson process of its weight as rate, each to a place
    drawn evenly; times and places follow from the shingle alone. Two texts agree at a place with their
    probability Jaccard similarity. A shingle is dropped once its next arrival comes later than the last
    of the first arrivals, which ends most of them after one or two.
    """
    first = np.full(places, np.inf)
    who = np.zeros(places, np.uint64)
    clock = np.zeros(len(shingles))
    live = np.arange(len(shingles))
    number = 0
    while len(live):
        block = max(1, 4 * places // len(live))
        steps = (np.arange(number + 1, number + block + 1, dtype=np.uint64) * _STEP)[None, :]
        random = mixed(shingles[live, None] + steps)
        gaps = -np.log1p(-(random >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weight[live, None]
        times = clock[live, None] + np.cumsum(gaps, axis=1)
        where = (mixed(random ^ _MIX_1) % np.uint64(places)).astype(np.int64)
        clock[live] = times[:, -1]
        number += block
        early = times < first[where]
        t, w = times[early], where[early]
        s = np.broadcast_to(shingles[live, None], times.shape)[early]
        # Of arrivals at one place the earliest is assigned last; equal times go to the smaller shingle.
        order = np.lexsort((s, t))[::-1]
        first[w[order]] = t[order]
        who[w[order]] = s[order]
        live = live[clock[live] < first.max()]
    return who


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """The probability Jaccard similarity of two weighted sets in order.

    The sum over common d of 1 / sum over e of max(a_e / a_d, b_e / b_d). With equal weights this is the
    share of common elements.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    every = np.union1d(a, b)
    x, y = np.zeros(len(every)), np.zeros(len(every))
    x[np.searchsorted(every, a)] = wa
    y[np.searchsorted(every, b)] = wb
    both = (x > 0) & (y > 0)
    if not both.any():
        return 0.0
    # max(x_e / x_d, y_e / y_d) is the second where y_e / x_e is over y_d / x_d.
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    below = np.concatenate([[0.0], np.cumsum(x[order])])
    above = np.concatenate([[0.0], np.cumsum(y[order][::-1])])[::-1]
    up_to = np.searchsorted(ratio[order], ratio[both], side="right")
    return float(np.sum(1.0 / (below[up_to] / x[both] + above[up_to] / y[both])))
