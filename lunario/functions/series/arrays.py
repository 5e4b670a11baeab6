"""Tier C: calculators that need linear algebra, transforms or counting over pairs, in numpy.

Each takes the series as an array of doubles and gives a value per parameter set, in the order of ``PARAMETERS``; what
is not defined for a series is NaN.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np

from lunario.functions.stats import norm_cdf, t_two_sided

NAN = float("nan")
QUANTILE_PAIRS = [(lo, hi) for lo in (0.0, 0.2, 0.4, 0.6, 0.8) for hi in (0.2, 0.4, 0.6, 0.8, 1.0) if lo < hi]
WIDTHS = (2, 5, 10, 20)
# Public names of the calculators and the parameters of each.
PARAMETERS: dict[str, list[dict]] = {
    "fft_coefficient": [{"attr": a, "coeff": k} for a in ("real", "imag", "abs", "angle") for k in range(100)],
    "fft_aggregated": [{"aggtype": a} for a in ("centroid", "variance", "skew", "kurtosis")],
    "fourier_entropy": [{"bins": b} for b in (2, 3, 5, 10, 100)],
    "ar_coefficient": [{"coeff": c, "k": 10} for c in range(11)],
    "partial_autocorrelation": [{"lag": k} for k in range(10)],
    "permutation_entropy": [{"dimension": d, "tau": 1} for d in (3, 4, 5, 6, 7)],
    "spkt_welch_density": [{"coeff": k} for k in (2, 5, 8)],
    "cwt_coefficients": [{"coeff": c, "w": w, "widths": WIDTHS} for w in WIDTHS for c in range(15)],
    "agg_autocorrelation": [{"f_agg": f, "maxlag": 40} for f in ("mean", "median", "var")],
    "matrix_profile": [{"feature": f, "threshold": 0.98} for f in ("min", "max", "mean", "median", "25", "75")],
    "sample_entropy": [{}],
    "approximate_entropy": [{"m": 2, "r": r} for r in (0.1, 0.3, 0.5, 0.7, 0.9)],
    "binned_entropy": [{"max_bins": 10}],
    "change_quantiles": [{"f_agg": f, "isabs": b, "qh": hi, "ql": lo} for lo, hi in QUANTILE_PAIRS for b in (False, True) for f in ("mean", "var")],
    "lempel_ziv_complexity": [{"bins": b} for b in (2, 3, 5, 10, 100)],
    "agg_linear_trend": [{"attr": a, "chunk_len": c, "f_agg": f} for a in ("rvalue", "intercept", "slope", "stderr") for c in (5, 10, 50) for f in ("max", "min", "mean", "var")],
    "linear_trend": [{"attr": a} for a in ("pvalue", "rvalue", "intercept", "slope", "stderr")],
    "augmented_dickey_fuller": [{"attr": a, "autolag": "AIC"} for a in ("teststat", "pvalue", "usedlag")],
    "benford_correlation": [{}],
    "index_mass_quantile": [{"q": q} for q in (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)],
    "energy_ratio_by_chunks": [{"num_segments": 10, "segment_focus": k} for k in range(10)],
    "query_similarity_count": [{"query": None, "threshold": 0.0}],
    "friedrich_coefficients": [{"coeff": k, "m": 3, "r": 30} for k in range(4)],
    "max_langevin_fixed_point": [{"m": 3, "r": 30}],
}


def _line(y: np.ndarray) -> dict[str, float]:
    """Least-squares line over 0..n-1 with its usual statistics."""
    n = len(y)
    if n < 2:
        return {}
    x = np.arange(n) - (n - 1) / 2
    sx, sy, sxy = x @ x, float(((y - y.mean()) ** 2).sum()), float(x @ (y - y.mean()))
    slope = sxy / sx
    r = 0.0 if sy == 0 else max(-1.0, min(1.0, sxy / math.sqrt(sx * sy)))
    out = {"slope": slope, "intercept": y.mean() - slope * (n - 1) / 2, "rvalue": r}
    if n > 2:
        out["stderr"] = math.sqrt((1 - r * r) * sy / sx / (n - 2))
        t = r * math.sqrt((n - 2) / max(1e-300, (1 - r) * (1 + r)))
        out["pvalue"] = t_two_sided(t, n - 2)
    else:
        out |= {"stderr": 0.0, "pvalue": 1.0 if y[0] == y[1] else 0.0}
    return out


def linear_trend(x, ps):
    line = _line(x)
    return [line.get(p["attr"], NAN) for p in ps]


def agg_linear_trend(x, ps):
    lines = {}
    for p in ps:
        key = p["chunk_len"], p["f_agg"]
        if key not in lines:
            parts = [x[i : i + p["chunk_len"]] for i in range(0, len(x), p["chunk_len"])]
            lines[key] = _line(np.array([getattr(np, p["f_agg"])(c) for c in parts]))
    return [lines[p["chunk_len"], p["f_agg"]].get(p["attr"], NAN) for p in ps]


def fft_coefficient(x, ps):
    f = np.fft.rfft(x)
    views = {"real": f.real, "imag": f.imag, "abs": np.abs(f), "angle": np.angle(f, deg=True)}
    return [float(views[p["attr"]][p["coeff"]]) if p["coeff"] < len(f) else NAN for p in ps]


def fft_aggregated(x, ps):
    y = np.abs(np.fft.rfft(x))
    total = y.sum()
    if total == 0:
        return [NAN] * len(ps)
    m = [float((np.arange(len(y)) ** k) @ y / total) for k in range(5)]
    var = m[2] - m[1] ** 2
    far = var >= 0.5
    return [
        {
            "centroid": m[1], "variance": var,
            "skew": (m[3] - 3 * m[1] * var - m[1] ** 3) / var**1.5 if far else NAN,
            "kurtosis": (m[4] - 4 * m[1] * m[3] + 6 * m[2] * m[1] ** 2 - 3 * m[1] ** 4) / var**2 if far else NAN,
        }[p["aggtype"]] for p in ps
    ]


def _welch(x: np.ndarray) -> np.ndarray:
    """Power density by averaged windowed segments, half overlapping, each without its mean."""
    n = min(len(x), 256)
    w = np.sin(np.pi * np.arange(n) / n) ** 2
    starts = range(0, len(x) - n + 1, n - n // 2)
    p = np.mean([np.abs(np.fft.rfft((x[s : s + n] - x[s : s + n].mean()) * w)) ** 2 for s in starts], axis=0) / max(1e-300, float(w @ w))
    p[1 : len(p) - (n % 2 == 0)] *= 2
    return p


def spkt_welch_density(x, ps):
    p = _welch(x)
    return [float(p[q["coeff"]]) if q["coeff"] < len(p) else NAN for q in ps]


def _entropy_of_bins(x: np.ndarray, bins: int) -> float:
    counts, _ = np.histogram(x, bins=bins)
    p = counts[counts > 0] / len(x)
    return float(-(p * np.log(p)).sum())


def binned_entropy(x, ps):
    return [_entropy_of_bins(x, p["max_bins"]) for p in ps]


def fourier_entropy(x, ps):
    s = _welch(x)
    top = s.max()
    return [_entropy_of_bins(s / top, p["bins"]) if top > 0 else NAN for p in ps]


def _regress(design: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    b, *_ = np.linalg.lstsq(design, y, rcond=None)
    return b, float(((y - design @ b) ** 2).sum())


def ar_coefficient(x, ps):
    k, n = ps[0]["k"], len(x)
    if n <= 2 * k:
        return [NAN] * len(ps)
    design = np.column_stack([np.ones(n - k), *[x[k - j : n - j] for j in range(1, k + 1)]])
    b, _ = _regress(design, x[k:])
    return [float(b[p["coeff"]]) for p in ps]


def _acf(x: np.ndarray, most: int) -> np.ndarray:
    """Autocovariance at lags 0..most, each over its own number of pairs, as share of that at lag 0."""
    z, n = x - x.mean(), len(x)
    c = np.array([float(z[k:] @ z[: n - k]) / (n - k) for k in range(most + 1)])
    return c / c[0]


def partial_autocorrelation(x, ps):
    n, want = len(x), max(p["lag"] for p in ps)
    most = min(want, n // 2 - 1)
    if n < 4 or x.std() < 1e-12 or most < 1:
        return [NAN] * len(ps)
    r = _acf(x, most)
    out, a = [1.0], np.zeros(0)
    for k in range(1, most + 1):  # Levinson and Durbin
        left = 1 - a @ r[1:k]
        if abs(left) < 1e-12:
            break
        last = (r[k] - a @ r[1:k][::-1]) / left
        a = np.r_[a - last * a[::-1], last]
        out.append(float(last))
    return [out[p["lag"]] if p["lag"] < len(out) else NAN for p in ps]


def agg_autocorrelation(x, ps):
    most = min(ps[0]["maxlag"], len(x) - 1)
    if most < 1 or x.std() < 1e-12:
        return [0.0] * len(ps)
    a = _acf(x, most)[1:]
    return [float(getattr(np, p["f_agg"])(a)) for p in ps]


def permutation_entropy(x, ps):
    out = []
    for p in ps:
        d, n = p["dimension"], len(x) - (p["dimension"] - 1) * p["tau"]
        if n < 1:
            out.append(NAN)
            continue
        windows = np.lib.stride_tricks.sliding_window_view(x, d)
        _, counts = np.unique(np.argsort(windows, axis=1, kind="stable"), axis=0, return_counts=True)
        q = counts / n
        out.append(float(-(q * np.log(q)).sum()))
    return out


def cwt_coefficients(x, ps):
    n, rows = len(x), {}
    for w in WIDTHS:
        m = min(10 * w, n)
        t = np.arange(m) - (m - 1) / 2
        hat = 2 / (math.sqrt(3 * w) * math.pi**0.25) * (1 - (t / w) ** 2) * np.exp(-((t / w) ** 2) / 2)
        full = np.convolve(x, hat[::-1], "full")
        rows[w] = full[(m - 1) // 2 :][:n]
    return [float(rows[p["w"]][p["coeff"]]) if p["coeff"] < n else NAN for p in ps]


def _near(x: np.ndarray, m: int, r: float) -> np.ndarray:
    """For each window of length ``m``, how many windows lie within ``r`` in every place; by blocks of rows."""
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    step = max(1, 2_000_000 // (len(w) * m))
    return np.concatenate([(np.abs(w[i : i + step, None, :] - w[None, :, :]).max(axis=2) <= r).sum(axis=1) for i in range(0, len(w), step)])


def sample_entropy(x, ps):
    n, r = len(x), 0.2 * x.std()
    if n < 4:
        return [NAN]
    b, a = _near(x[:-1], 2, r).sum() - (n - 2), _near(x, 3, r).sum() - (n - 2)
    return [float(-math.log(a / b)) if a > 0 and b > 0 else NAN]


def approximate_entropy(x, ps):
    n, sd, out = len(x), x.std(), []
    for p in ps:
        if n <= p["m"] + 1:
            out.append(0.0)
            continue
        phi = [float(np.log(_near(x, m, p["r"] * sd) / (n - m + 1)).mean()) for m in (p["m"], p["m"] + 1)]
        out.append(abs(phi[0] - phi[1]))
    return out


def change_quantiles(x, ps):
    out, d = [], np.diff(x)
    for p in ps:
        lo, hi = np.quantile(x, p["ql"]), np.quantile(x, p["qh"])
        inside = (x >= lo) & (x <= hi)
        c = d[inside[1:] & inside[:-1]]
        c = np.abs(c) if p["isabs"] else c
        out.append(float(getattr(np, p["f_agg"])(c)) if len(c) else 0.0)
    return out


def lempel_ziv_complexity(x, ps):
    out = []
    for p in ps:
        digits = np.searchsorted(np.linspace(x.min(), x.max(), p["bins"] + 1)[1:], x, side="left").tolist()
        known, i, k, n = set(), 0, 1, len(digits)
        while i + k <= n:
            word = tuple(digits[i : i + k])
            if word in known:
                k += 1
            else:
                known.add(word)
                i, k = i + k, 1
        out.append(len(known) / n)
    return out


# MacKinnon's surface for a unit root with constant, one series (1994).
_ADF_STAR, _ADF_LEAST, _ADF_MOST = -1.61, -18.83, 2.74
_ADF_SMALL, _ADF_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def augmented_dickey_fuller(x, ps):
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most < 0 or np.ptp(x) == 0:
        return [NAN] * len(ps)
    d = np.diff(x)

    def fit(lags: int, skip: int):
        y = d[skip:]
        cols = [x[skip : n - 1], *[d[skip - j : len(d) - j] for j in range(1, lags + 1)], np.ones(len(y))]
        design = np.column_stack(cols)
        b, rss = _regress(design, y)
        return b, rss, design, len(y)

    best = None
    for lags in range(most + 1):
        b, rss, design, m = fit(lags, most)
        aic = m * math.log(max(rss, 1e-300) / m) + 2 * design.shape[1]
        if best is None or aic < best[0]:
            best = (aic, lags)
    lags = best[1]
    b, rss, design, m = fit(lags, lags)
    free = m - design.shape[1]
    if free <= 0:
        return [NAN] * len(ps)
    cov = np.linalg.pinv(design.T @ design) * rss / free
    if cov[0, 0] <= 0:
        return [NAN] * len(ps)
    t = float(b[0] / math.sqrt(cov[0, 0]))
    if t > _ADF_MOST:
        pv = 1.0
    elif t < _ADF_LEAST:
        pv = 0.0
    else:
        pv = norm_cdf(sum(c * t**k for k, c in enumerate(_ADF_SMALL if t <= _ADF_STAR else _ADF_LARGE)))
    return [{"teststat": t, "pvalue": pv, "usedlag": float(lags)}[p["attr"]] for p in ps]


def benford_correlation(x, ps):
    firsts = [int(f"{abs(v):e}"[0]) for v in x if v != 0 and np.isfinite(v)]
    seen = np.array([sum(f == k for f in firsts) / max(1, len(firsts)) for k in range(1, 10)])
    law = np.log10(1 + 1 / np.arange(1, 10))
    return [float(np.corrcoef(law, seen)[0, 1]) if seen.std() > 0 else NAN]


def index_mass_quantile(x, ps):
    mass = np.abs(x).cumsum()
    if mass[-1] == 0:
        return [NAN] * len(ps)
    return [float((np.argmax(mass / mass[-1] >= p["q"]) + 1) / len(x)) for p in ps]


def energy_ratio_by_chunks(x, ps):
    total = float(x @ x)
    parts = np.array_split(x, ps[0]["num_segments"])
    return [float(parts[p["segment_focus"]] @ parts[p["segment_focus"]]) / total if total else NAN for p in ps]


def query_similarity_count(x, ps):
    """How many windows lie within the threshold of the query, both without their mean and scale; 0 without a query."""
    out = []
    for p in ps:
        q = np.asarray(p["query"] if p["query"] is not None else [], float)
        if not len(q):
            out.append(0.0)
            continue
        if len(q) > len(x) or q.std() == 0:
            out.append(NAN)
            continue
        w = np.lib.stride_tricks.sliding_window_view(x, len(q))
        sd = w.std(axis=1)
        z = (w - w.mean(axis=1, keepdims=True)) / np.where(sd > 1e-12, sd, np.inf)[:, None]
        out.append(float((np.sqrt(((z - (q - q.mean()) / q.std()) ** 2).sum(axis=1)) <= p["threshold"]).sum()))
    return out


def _drift(x: np.ndarray, degree: int, cells: int) -> np.ndarray | None:
    """Polynomial of the mean step against the mean level, over cells of equally many levels; none if levels repeat at a cell's edge."""
    level, step = x[:-1], np.diff(x)
    if len(level) <= degree:
        return None
    edges = np.quantile(level, np.linspace(0, 1, cells + 1))
    if (np.diff(edges) <= 0).any():
        return None
    cell = np.clip(np.searchsorted(edges, level, side="left") - 1, 0, cells - 1)
    n = np.bincount(cell, minlength=cells)
    full = n > 0
    if full.sum() <= degree:
        return None
    return np.polyfit(np.bincount(cell, level, cells)[full] / n[full], np.bincount(cell, step, cells)[full] / n[full], degree)


def friedrich_coefficients(x, ps):
    c = _drift(x, ps[0]["m"], ps[0]["r"])
    return [NAN if c is None else float(c[p["coeff"]]) for p in ps]


def max_langevin_fixed_point(x, ps):
    c = _drift(x, ps[0]["m"], ps[0]["r"])
    return [NAN if c is None or not len(np.roots(c)) else float(np.roots(c).real.max())]


def matrix_profile(x, ps):
    """Distances of each normalised window (a quarter of the series, 4 at least) to its nearest one that does not overlap it by half."""
    n = len(x)
    m = max(4, n // 4)
    if n < 2 * m:
        return [NAN] * len(ps)
    w = np.lib.stride_tricks.sliding_window_view(x, m).astype(float)
    sd = w.std(axis=1, keepdims=True)
    z = np.where(sd > 1e-12, (w - w.mean(axis=1, keepdims=True)) / np.where(sd > 1e-12, sd, 1), 0.0)
    dist = np.sqrt(np.maximum(0, (z * z).sum(1)[:, None] + (z * z).sum(1)[None, :] - 2 * z @ z.T))
    i = np.arange(len(w))
    dist[np.abs(i[:, None] - i[None, :]) <= m // 2] = np.inf
    best = dist.min(axis=1)
    best = best[np.isfinite(best)]
    if not len(best):
        return [NAN] * len(ps)
    stats = {"min": best.min(), "max": best.max(), "mean": best.mean(), "median": np.median(best), "25": np.percentile(best, 25), "75": np.percentile(best, 75)}
    return [float(stats[p["feature"]]) for p in ps]


CALCULATORS: dict[str, Callable] = {name: globals()[name] for name in PARAMETERS}


def evaluate(x: np.ndarray, names: list[str]) -> list[float]:
    """All values of the named calculators, one after the other; NaN where a series is too short or a value is not finite."""
    out = []
    with np.errstate(all="ignore"):
        for name in names:
            ps = PARAMETERS[name]
            values = CALCULATORS[name](x, ps) if len(x) else [NAN] * len(ps)
            out.append([v if v is not None and math.isfinite(v) else NAN for v in values])
    return list(itertools.chain.from_iterable(out))
