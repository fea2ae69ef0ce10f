"""The configuration linear program of packing: how often to use each multiset of lengths (pattern) that fits a sequence.

    minimise the sum of x[p]  with  the sum of a[p, n] * x[p] >= counts[n] for each length n,  x >= 0

Multiplicative weights hold a price for each length. A round asks the pricing problem for the pattern of most worth, a
knapsack solved by dynamic programming over the capacity, and uses it as far as its scarcest length lasts; prices of what it
covers fall by a factor exponential in the share covered. Any prices bound the program from below (counts times prices,
divided by the worth of the best pattern), so the gap between the value reached and the best bound met is known.

Lengths start with prices slightly steeper than proportional, which leaves short pieces, the ones that fill any gap, for later
rounds; a price of zero has a length that is covered. A round covers one length at least to its end, so there are at most
as many rounds as lengths, whatever the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np

#: The exponent of the first prices, and how far a full cover presses a price down.
STEEP, STEP = 1.05, 0.2
#: Rooms that one step of the dynamic program takes together; shorter lengths are added one by one.
_BLOCK = 32
#: Patterns besides the best that one pricing may serve, and by which share they may be worse.
REUSE, NEARLY = 16, 1e-3


class Knapsack:
    """The multiset of lengths of most worth that fits the capacity, to within the rounding of 32-bit floats."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def solve(self, worth: np.ndarray) -> tuple[float, Counter]:
        """worth[n] is that of a piece of length n; 0: not offered. Returns the best pattern's worth and the pattern."""
        self.price(worth)
        best = self.pattern(self.capacity)
        return float(sum(float(worth[n]) * k for n, k in best.items())), best

    def price(self, worth: np.ndarray) -> None:
        """Works out the best pattern of every room."""
        size, far = self.capacity, min(_BLOCK, self.capacity)
        worth = worth.astype(np.float32)
        offered = np.where(worth > 0, worth, np.float32(-np.inf))
        # windows over `best` run backwards through the lengths: entry j of a window is what stays after a length of size - j
        value = offered[::-1].copy()
        value[size - far + 1 :] = -np.inf
        held = np.full(2 * size + 1, -np.inf, np.float32)
        best, choice = held[size:], np.zeros(size + 1, np.int64)
        best[:far] = 0.0
        windows = np.lib.stride_tricks.sliding_window_view(held, size + 1)
        for low in range(far, size + 1, far):
            high = min(low + far, size + 1)
            first = size - high + 1
            total = windows[low:high, first:] + value[first:]
            top = total.argmax(axis=1)
            found = total[np.arange(high - low), top]
            choice[low:high] = np.where(found > 0, size - first - top, 0)
            best[low:high] = np.maximum(found, 0.0)
        # a short length is added once, twice, four times and so on, each time on top of what there is
        steps: list[tuple[int, int, np.ndarray]] = []
        for n in np.nonzero(worth[1:far] > 0)[0].tolist():
            n, times = n + 1, 1
            while n * times <= size:
                before = best.copy()
                np.maximum(best[n * times :], before[: size + 1 - n * times] + np.float32(times) * worth[n], out=best[n * times :])
                steps.append((n, times, before))
                times *= 2
        self.worth, self.best, self.choice, self.steps = worth, best, choice, steps

    def pattern(self, room: int) -> Counter:
        """The best pattern that fits the room."""
        out: Counter = Counter()
        now = self.best
        for n, times, before in reversed(self.steps):
            if now[room] > before[room]:
                out[n] += times
                room -= n * times
            now = before
        while room > 0 and self.choice[room]:
            out[int(self.choice[room])] += 1
            room -= int(self.choice[room])
        return out

    def patterns_through(self, lengths: np.ndarray) -> Iterator[Counter]:
        """For each length the best pattern that holds it, in descending order of worth."""
        total = self.worth[lengths] + self.best[self.capacity - lengths]
        for n in lengths[np.argsort(-total, kind="stable")].tolist():
            if self.worth[n] > 0:
                yield self.pattern(self.capacity - n) + Counter({n: 1})


@dataclass
class Solution:
    """use: patterns and how often each; value: their sum; bound: no solution is below it."""

    use: list[tuple[Counter, float]] = field(default_factory=list)
    value: float = 0.0
    bound: float = 0.0


def _no_more_than_there_are(pattern: Counter, counts: dict[int, int], worth: np.ndarray) -> None:
    """Replaces pieces that the pattern has more often than there are by others; all rooms of a pattern are real ones then."""
    spent = set()
    while over := [n for n, k in pattern.items() if k > counts[n]]:
        for n in over:
            pattern[n] = counts[n]
        spent |= {n for n, k in pattern.items() if k == counts[n]}
        room = len(worth) - 1 - sum(n * k for n, k in pattern.items())
        rest = worth[: room + 1].copy()
        rest[[n for n in spent if n <= room]] = 0.0
        if rest.any():
            pattern.update(Knapsack(room).solve(rest)[1])


def solve(counts: dict[int, int], capacity: int, step: float = STEP, steep: float = STEEP, reuse: int = REUSE) -> Solution:
    """A fractional cover of counts (pieces by length) that uses every piece exactly once."""
    lengths = np.array(sorted(counts), np.int64)
    need = np.array([counts[n] for n in lengths.tolist()], float)
    first = (lengths / capacity) ** steep
    left, out, knapsack = need.copy(), Solution(), Knapsack(capacity)
    volume = float((lengths * need).sum()) / capacity
    out.bound = volume
    worth = np.zeros(capacity + 1)
    while left.any():
        price = np.where(left > 0, first * np.exp(-step * (1 - left / need)), 0.0)
        worth[lengths] = price
        total, pattern = knapsack.solve(worth)
        # the best pattern may be better by what 32-bit sums round off
        out.bound = max(out.bound, float((price * need).sum()) / (total * (1 + 1e-5)))
        # one pricing serves several patterns that are nearly as good as the best
        _no_more_than_there_are(pattern, counts, worth)
        others = (p for p in islice(knapsack.patterns_through(lengths), reuse) if all(k <= counts[n] for n, k in p.items()))
        near = (p for p in others if sum(worth[n] * k for n, k in p.items()) >= (1 - NEARLY) * total)
        # the first of them covers a length to its end, so every round comes on
        for pattern in [pattern, *near]:
            at = np.searchsorted(lengths, list(pattern))
            mine = np.array(list(pattern.values()), float)
            amount = float((left[at] / mine).min())
            if amount > 0:
                left[at] -= amount * mine
                left[left < 1e-9 * need] = 0.0
                out.use.append((pattern, amount))
                out.value += amount
    return out


def rounded(solution: Solution, counts: dict[int, int]) -> tuple[list[tuple[Counter, int]], dict[int, int]]:
    """Patterns used a whole number of times, and the pieces that are left: first the whole parts, then, by their fractions,
    the patterns of which all pieces are still there."""
    left, out = dict(counts), []

    def use(pattern: Counter, times: int) -> None:
        times = min(times, *(left[n] // k for n, k in pattern.items()))
        if times:
            out.append((pattern, times))
            for n, k in pattern.items():
                left[n] -= k * times

    for pattern, amount in solution.use:
        use(pattern, int(amount + 1e-9))
    for pattern, amount in sorted(solution.use, key=lambda x: -(x[1] % 1)):
        if amount % 1 > 1e-9:
            use(pattern, 1)
    return out, {n: c for n, c in left.items() if c}
