"""Controlled rounding of two-way tables by maximum flow.

Works on the driver, over target tables whose size the callers check; nothing here grows with the data.
"""

from __future__ import annotations

import math
from collections import deque
from fractions import Fraction


class _Flow:
    """Maximum flow by shortest augmenting paths over an adjacency list."""

    def __init__(self, n: int) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.at: list[list[int]] = [[] for _ in range(n)]

    def edge(self, a: int, b: int, cap: int) -> int:
        self.at[a].append(len(self.to))
        self.to.append(b)
        self.cap.append(cap)
        self.at[b].append(len(self.to))
        self.to.append(a)
        self.cap.append(0)
        return len(self.to) - 2

    def push(self, s: int, t: int) -> int:
        total = 0
        while True:
            came: dict[int, int] = {s: -1}
            queue = deque([s])
            while queue and t not in came:
                a = queue.popleft()
                for e in self.at[a]:
                    if self.cap[e] and self.to[e] not in came:
                        came[self.to[e]] = e
                        queue.append(self.to[e])
            if t not in came:
                return total
            path, b = [], t
            while b != s:
                path.append(came[b])
                b = self.to[came[b] ^ 1]
            step = min(self.cap[e] for e in path)
            for e in path:
                self.cap[e] -= step
                self.cap[e ^ 1] += step
            total += step


def controlled_round(table: dict[tuple, Fraction]) -> dict[tuple, int]:
    """Integers for a fractional table keyed by (row, column): every cell, row sum, column sum and the grand total become
    the floor or the ceiling of what they were (so whole margins are kept exactly).

    A circulation with lower bounds source -> rows -> cells -> columns -> sink -> source always has a whole solution,
    since the fractional table is one and the bounds are whole.
    """
    rows = sorted({r for r, _ in table}, key=str)
    cols = sorted({c for _, c in table}, key=str)
    node = {("r", r): i + 2 for i, r in enumerate(rows)} | {("c", c): i + 2 + len(rows) for i, c in enumerate(cols)}
    n = 2 + len(node)
    s, t, over, under = 0, 1, n, n + 1
    flow, need = _Flow(n + 2), [0] * n

    def bounded(a: int, b: int, value: Fraction) -> tuple[int, int]:
        low = math.floor(value)
        need[b] += low
        need[a] -= low
        return flow.edge(a, b, math.ceil(value) - low), low

    sums = lambda keep: sum((v for k, v in table.items() if keep(k)), Fraction(0))
    for r in rows:
        bounded(s, node["r", r], sums(lambda k, r=r: k[0] == r))
    cells = {k: bounded(node["r", k[0]], node["c", k[1]], v) for k, v in sorted(table.items(), key=str)}
    for c in cols:
        bounded(node["c", c], t, sums(lambda k, c=c: k[1] == c))
    bounded(t, s, sums(lambda k: True))
    wanted = 0
    for v, x in enumerate(need):
        if x > 0:
            flow.edge(over, v, x)
            wanted += x
        elif x < 0:
            flow.edge(v, under, -x)
    if flow.push(over, under) != wanted:
        raise ArithmeticError("the table cannot be rounded")
    return {k: low + flow.cap[e ^ 1] for k, (e, low) in cells.items()}


def reachable(required: dict[tuple, int], available: dict[tuple, int]) -> dict[tuple, int]:
    """How much of each cell's requirement can be met: the maximum flow through rows and columns that want the sums of their
    cells' requirements, over cells that pass no more than is required of them and there is."""
    rows, cols = sorted({r for r, _ in required}, key=str), sorted({c for _, c in required}, key=str)
    node = {("r", r): i + 2 for i, r in enumerate(rows)} | {("c", c): i + 2 + len(rows) for i, c in enumerate(cols)}
    flow = _Flow(2 + len(node))
    for r in rows:
        flow.edge(0, node["r", r], sum(v for k, v in required.items() if k[0] == r))
    for c in cols:
        flow.edge(node["c", c], 1, sum(v for k, v in required.items() if k[1] == c))
    cells = {k: flow.edge(node["r", k[0]], node["c", k[1]], min(v, available[k])) for k, v in sorted(required.items(), key=str)}
    flow.push(0, 1)
    return {k: flow.cap[e ^ 1] for k, e in cells.items()}


def bounded_shares(weights: dict, low: dict, high: dict, total: int) -> dict[tuple, Fraction]:
    """Quotas in proportion to ``weights`` that add up to ``total`` within ``low`` and ``high`` (as far as these allow it).

    The common factor is found exactly: cells that break a bound are fixed at it, on the side that breaks more, until the
    rest keeps to its bounds.
    """
    low = {k: min(low[k], high[k]) for k in weights}
    if sum(low.values()) >= total:
        return {k: Fraction(v) for k, v in low.items()}
    fixed: dict = {}
    while len(fixed) < len(weights):
        free = [k for k in weights if k not in fixed]
        left, mass = Fraction(total) - sum(fixed.values()), sum(Fraction(weights[k]) for k in free)
        guess = {k: left * Fraction(weights[k]) / mass if mass else Fraction(low[k]) for k in free}
        short = {k: low[k] - v for k, v in guess.items() if v < low[k]}
        above = {k: v - high[k] for k, v in guess.items() if v > high[k]}
        if not short and not above:
            return fixed | guess
        if sum(short.values()) >= sum(above.values()):
            fixed |= {k: Fraction(low[k]) for k in short}
        else:
            fixed |= {k: Fraction(high[k]) for k in above}
    return fixed
