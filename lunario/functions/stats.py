"""Distributions and tests of significance, without a statistics library."""

from __future__ import annotations

import math

import numpy as np


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, free: float) -> float:
    """Probability of a value of Student's t at least as far from 0."""
    return beta_share(free / 2, 0.5, free / (free + t * t))


def _inversions(y: np.ndarray, w: np.ndarray) -> float:
    """Weight of the pairs that stand in falling order, by merging halves."""
    order = np.argsort(y, kind="stable")
    rank = np.empty(len(y), np.int64)
    _, rank[order] = None, np.unique(y[order], return_inverse=True)[1]
    tree, total, seen = np.zeros(rank.max() + 2), 0.0, 0.0
    size = len(tree)
    for r, k in zip(rank.tolist(), w.tolist(), strict=True):
        i, below = r + 1, 0.0
        while i > 0:
            below += tree[i]
            i -= i & -i
        total += k * (seen - below)
        seen += k
        i = r + 1
        while i < size:
            tree[i] += k
            i += i & -i
    return total


def kendall(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Two-sided p-value of Kendall's tau-b of weighted pairs, by its normal approximation with ties."""
    n = float(w.sum())
    order = np.lexsort((y, x))
    x, y, w = x[order], y[order], w[order].astype(float)

    def ties(v: np.ndarray) -> np.ndarray:
        return np.bincount(np.unique(v, return_inverse=True)[1], w)

    tx, ty = ties(x), ties(y)
    both = np.bincount(np.unique(np.stack([x, y]), axis=1, return_inverse=True)[1].ravel(), w)
    pairs = lambda t: float((t * (t - 1)).sum()) / 2
    # Pairs of equal x are in rising order of y, so no inversion lies among them.
    down = _inversions(y, w)
    total = n * (n - 1) / 2
    score = total - pairs(tx) - pairs(ty) + pairs(both) - 2 * down
    cubes = lambda t: float((t * (t - 1) * (t - 2)).sum())
    spread = lambda t: float((t * (t - 1) * (2 * t + 5)).sum())
    m = n * (n - 1)
    var = (m * (2 * n + 5) - spread(tx) - spread(ty)) / 18 + 2 * pairs(tx) * pairs(ty) / m
    if n > 2:
        var += cubes(tx) * cubes(ty) / (9 * m * (n - 2))
    return math.erfc(abs(score) / math.sqrt(var) / math.sqrt(2)) if var > 0 else 1.0


def mann_whitney(x: np.ndarray, group: np.ndarray, w: np.ndarray) -> float:
    """Two-sided p-value that two groups of weighted values have one distribution: normal approximation with ties and continuity."""
    values, at = np.unique(x, return_inverse=True)
    t, t1 = np.bincount(at, w), np.bincount(at, w * group)
    n, n1 = t.sum(), t1.sum()
    n2 = n - n1
    rank = np.cumsum(t) - (t - 1) / 2
    u = float((rank * t1).sum()) - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * (n + 1 - float((t**3 - t).sum()) / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2)))


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p-value of a table of four counts: tables at most as likely as it, margins given."""
    n, row, col = a + b + c + d, a + b, a + c
    low, high = max(0, row + col - n), min(row, col)
    k = np.arange(low, high + 1)
    lf = np.r_[0.0, np.cumsum(np.log(np.arange(1, n + 1)))]  # logarithms of factorials
    logs = -(lf[k] + lf[row - k] + lf[col - k] + lf[n - row - col + k])
    p = np.exp(logs - logs.max())
    own = p[a - low]
    return float(min(1.0, p[p <= own * (1 + 1e-7)].sum() / p.sum()))


def _paths(n1: int, n2: int, h: int) -> float:
    """Share of the lattice paths from (0, 0) to (n1, n2) that somewhere have |i n2 - j n1| >= h."""
    if h <= 0:
        return 1.0
    low, row, scale = 0, np.ones(min(n2, (h - 1) // n1) + 1), 0.0
    for i in range(1, n1 + 1):
        begin, end = max(0, (i * n2 - h) // n1 + 1), min(n2, -((-i * n2 - h) // n1) - 1)
        if end < begin:
            return 1.0
        before = np.zeros(end - begin + 1)
        a, z = max(begin, low), min(end, low + len(row) - 1)
        if a <= z:
            before[a - begin : z - begin + 1] = row[a - low : z - low + 1]
        row, low = np.cumsum(before), begin
        if (top := row[-1]) == 0:
            return 1.0
        row, scale = row / top, scale + math.log(top)
    inside = scale + math.log(row[-1]) if low + len(row) - 1 == n2 else -math.inf
    return max(0.0, 1 - math.exp(inside - (math.lgamma(n1 + n2 + 1) - math.lgamma(n1 + 1) - math.lgamma(n2 + 1))))


def smirnov(y: np.ndarray, group: np.ndarray, w: np.ndarray) -> float:
    """Two-sided p-value that two groups of weighted values have one distribution, from their greatest distance.

    Exact for sizes up to 10,000; otherwise the limiting distribution at the effective size.
    """
    _, at = np.unique(y, return_inverse=True)
    t1, t2 = np.bincount(at, w * group), np.bincount(at, w * (1 - group))
    n1, n2 = float(t1.sum()), float(t2.sum())
    gap = float(np.abs(np.cumsum(t1) / n1 - np.cumsum(t2) / n2).max())
    if n1 == n2 <= 10_000:
        n, h = int(n1), int(round(gap * n1))
        if h == 0:
            return 1.0
        p = 0.0
        for k in range(n // h, -1, -1):
            step = 1.0
            for j in range(h):
                step = (n - k * h - j) * step / (n + k * h + j + 1)
            p = step * (1 - p)
        return min(1.0, 2 * p)
    if max(n1, n2) <= 10_000:
        return _paths(int(n1), int(n2), int(round(gap * n1 * n2)))
    z = gap * math.sqrt(n1 * n2 / (n1 + n2))
    if z < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101))))


def false_discovery(p: np.ndarray, level: float = 0.05) -> np.ndarray:
    """Which of the hypotheses are rejected at that share of false discoveries, whatever their dependence."""
    n = len(p)
    if not n:
        return np.zeros(0, bool)
    order = np.argsort(p, kind="stable")
    bound = level * np.arange(1, n + 1) / (n * float((1 / np.arange(1, n + 1)).sum()))
    below = np.flatnonzero(p[order] <= bound)
    out = np.zeros(n, bool)
    if len(below):
        out[order[: below[-1] + 1]] = True
    return out
