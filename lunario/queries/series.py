"""SQL of the calculators over daily series: each series is one list ``a`` of ``n`` values, with its moments."""

from __future__ import annotations

from lunario.functions.naming import plain_name
from lunario.functions.series.arrays import PARAMETERS, QUANTILE_PAIRS, WIDTHS
from lunario.functions.series.sql import ARRAYS, label

_LISTS = """WITH RECURSIVE e AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) b, sum(value) s FROM events GROUP BY 1, 2),
    z AS (SELECT user_id, min(b) lo, max(b) hi FROM e GROUP BY 1), g AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) b FROM z),
    f AS (SELECT user_id, b, coalesce(s, 0) v FROM g LEFT JOIN e USING (user_id, b)),
    x AS (SELECT user_id, list(v ORDER BY b) a, count(*) n, avg(v) m, stddev_pop(v) sd, min(v) lo, max(v) hi FROM f GROUP BY 1)"""


def _name(calculator: str, **params) -> str:
    return plain_name("somma__" + label(calculator, **params))


def _sql(columns: list[tuple[str, str]], more: str = "", last: str = "x", places: int = 4) -> str:
    return f"{_LISTS}{more} SELECT user_id, " + ", ".join(f'round(CAST(({sql}) AS DOUBLE), {places}) AS "{name}"' for name, sql in columns) + f" FROM {last}"


def _sum(term: str, low: str, high: str, var: str = "i") -> str:
    """Sum over low <= i < high, 0 over nothing."""
    return f"coalesce(list_sum([{term} for {var} in range({low}, {high})]), 0)"


def _peaks(p: int) -> str:
    return f"len([i for i in range({p + 1}, n - {p} + 1) if a[i] > list_max(a[i - {p}:i - 1]) and a[i] > list_max(a[i + 1:i + {p}])])"


def _lagged(k: int, term: str) -> str:
    return f"CASE WHEN n > {2 * k} THEN {_sum(term.format(x='a[i]', y=f'a[i + {k}]', z=f'a[i + {2 * k}]'), '1', f'n - {2 * k} + 1')} / (n - {2 * k}) ELSE 0 END"


def _autocorrelation(k: int) -> str:
    return "CASE WHEN sd > 0 THEN 1 END" if k == 0 else f"CASE WHEN sd > 1e-12 AND n > {k} THEN {_sum(f'(a[i] - m) * (a[i + {k}] - m)', '1', f'n - {k} + 1')} / ((n - {k}) * sd * sd) END"


def _line(y: str) -> dict[str, str]:
    """Least-squares line over 0, 1, ... of a list of at least three values; its p-value from the finite sums for whole degrees of freedom."""
    n = f"len({y})"
    mean, sx = f"list_avg({y})", f"({n} * ({n} * {n} - 1) / 12)"
    sxy, syy = _sum(f"(i - 1 - ({n} - 1) / 2) * {y}[i]", "1", f"{n} + 1"), f"({n} * list_var_pop({y}))"
    r = f"(CASE WHEN {syy} = 0 THEN 0 ELSE greatest(-1, least(1, {sxy} / sqrt({sx} * {syy}))) END)"
    some = lambda sql: f"CASE WHEN {n} > 1 THEN {sql} END"
    return {
        "slope": some(f"{sxy} / {sx}"), "intercept": some(f"{mean} - {sxy} / {sx} * ({n} - 1) / 2"), "rvalue": some(r),
        "stderr": some(f"CASE WHEN {n} = 2 THEN 0 ELSE sqrt(greatest(0, 1 - {r} * {r}) * {syy} / {sx} / nullif({n} - 2, 0)) END"),
    }


_T = """, l AS (SELECT user_id, n - 2 AS df, atan(rv * sqrt((n - 2) / greatest(1e-300, (1 - rv) * (1 + rv))) / sqrt(n - 2)) AS th FROM (SELECT user_id, n, {r} AS rv FROM x)),
    t AS (SELECT user_id, 1 - abs(CASE WHEN df % 2 = 0 THEN sin(th) * list_sum([coalesce(list_product([(2 * i - 1) / (2 * i) for i in range(1, j + 1)]), 1) * power(cos(th), 2 * j) for j in range(0, df // 2)])
        ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum([coalesce(list_product([(2 * i) / (2 * i + 1) for i in range(1, j + 1)]), 1) * power(cos(th), 2 * j + 1) for j in range(0, (df - 1) // 2)]), 0)) END) AS p FROM l),
    y AS (SELECT x.*, t.p FROM x JOIN t USING (user_id))"""
_WAVES = """, w AS (SELECT *, [list_sum([a[i + 1] * cos(2 * pi() * k * i / n) for i in range(0, n)]) for k in range(0, n // 2 + 1)] re, [round(-list_sum([a[i + 1] * sin(2 * pi() * k * i / n) for i in range(0, n)]), 8) + 0 for k in range(0, n // 2 + 1)] im,
        [sin(pi() * i / n) * sin(pi() * i / n) for i in range(0, n)] hann FROM x),
    v AS (SELECT *, [sqrt(re[k] * re[k] + im[k] * im[k]) for k in range(1, len(re) + 1)] am,
        [(power(list_sum([(a[i + 1] - m) * hann[i + 1] * cos(2 * pi() * k * i / n) for i in range(0, n)]), 2) + power(list_sum([(a[i + 1] - m) * hann[i + 1] * sin(2 * pi() * k * i / n) for i in range(0, n)]), 2))
            / list_sum([h * h for h in hann]) * CASE WHEN k = 0 OR 2 * k = n THEN 1 ELSE 2 END for k in range(0, n // 2 + 1)] pd FROM w),
    u AS (SELECT *, list_sum(am) tot, [list_sum([power(k - 1, q) * am[k] for k in range(1, len(am) + 1)]) / list_sum(am) for q in range(0, 5)] mo FROM v)"""
_FFT = {"real": "re[{k}]", "imag": "im[{k}]", "abs": "am[{k}]", "angle": "degrees(atan2(im[{k}], re[{k}]))"}
_VAR = "(mo[3] - mo[2] * mo[2])"
_SPREAD = {
    "centroid": "mo[2]", "variance": _VAR, "skew": f"CASE WHEN {_VAR} >= 0.5 THEN (mo[4] - 3 * mo[2] * {_VAR} - power(mo[2], 3)) / power({_VAR}, 1.5) END",
    "kurtosis": f"CASE WHEN {_VAR} >= 0.5 THEN (mo[5] - 4 * mo[2] * mo[4] + 6 * mo[3] * mo[2] * mo[2] - 3 * power(mo[2], 4)) / power({_VAR}, 2) END",
}


def _binned(values: str, bins: int) -> str:
    """Entropy of the shares of equal bins between the least and the greatest value."""
    low, high = f"list_min({values})", f"list_max({values})"
    cells = f"[least({bins - 1}, CAST(floor((q - {low}) / ({high} - {low}) * {bins}) AS BIGINT)) for q in {values}]"
    count = f"len([c for c in {cells} if c = b])"
    return f"CASE WHEN {high} > {low} THEN -list_sum([CASE WHEN {count} > 0 THEN {count} / len({values}) * ln({count} / len({values})) ELSE 0 END for b in range(0, {bins})]) ELSE 0 END"


def _near(size: int, tolerance: str, ends: str, i: str = "i") -> str:
    """How many windows of a size lie within the tolerance of the one at i."""
    return f"len([j for j in range(1, {ends}) if {' and '.join(f'abs(a[{i} + {k}] - a[j + {k}]) <= {tolerance}' for k in range(size))}])"


def _phi(m: int, r: float) -> str:
    return f"(list_sum([ln({_near(m, f'{r}::DOUBLE * sd', f'n - {m} + 2')} / (n - {m} + 1)) for i in range(1, n - {m} + 2)]) / (n - {m} + 1))"


def _permuted(d: int) -> str:
    patterns = f"[CAST([o.j for o in list_sort([{{'v': a[i + j], 'j': j}} for j in range(0, {d})])] AS VARCHAR) for i in range(1, n - {d} + 2)]"
    return f"-list_sum([c / (n - {d} + 1) * ln(c / (n - {d} + 1)) for c in map_values(list_histogram({patterns}))])"


_MATCH = (f"list_sum([{_near(2, '0.2::DOUBLE * sd', 'n - 1')} for i in range(1, n - 1)]) - (n - 2)", f"list_sum([{_near(3, '0.2::DOUBLE * sd', 'n - 1')} for i in range(1, n - 1)]) - (n - 2)")


def _hat(w: int, c: int) -> str:
    t = f"(((least({10 * w}, n) - 1) // 2 + {c} - i) - (least({10 * w}, n) - 1) / 2)"
    inside = f"(least({10 * w}, n) - 1) // 2 + {c} - i BETWEEN 0 AND least({10 * w}, n) - 1"
    return f"CASE WHEN {c} < n THEN " + _sum(f"CASE WHEN {inside} THEN a[i + 1] * 2 / (sqrt(3 * {w}) * power(pi(), 0.25)) * (1 - power({t} / {w}, 2)) * exp(-power({t} / {w}, 2) / 2) ELSE 0 END", "0", "n") + " END"


def _changes(f: str, isabs: bool, high: float, low: float) -> str:
    lo, hi = f"q[{round(low * 5) + 1}]", f"q[{round(high * 5) + 1}]"
    step = "abs(a[i + 1] - a[i])" if isabs else "a[i + 1] - a[i]"
    return f"coalesce({'list_avg' if f == 'mean' else 'list_var_pop'}([{step} for i in range(1, n) if a[i] BETWEEN {lo} AND {hi} and a[i + 1] BETWEEN {lo} AND {hi}]), 0)"


_CHUNK = {"max": "list_max", "min": "list_min", "mean": "list_avg", "var": "list_var_pop"}
_CHUNKS = (
    ", c AS (SELECT *, [quantile for quantile in [" + ", ".join(f"list_aggregate(a, 'quantile_cont', {k / 5})" for k in range(6)) + "]] q, list_sum([abs(v) for v in a]) mass, list_sum([v * v for v in a]) energy, [list_sum([abs(v) for v in a[1:i]]) for i in range(1, n + 1)] run, [d for d in [CAST(floor(round(abs(v) / power(10, floor(log10(round(abs(v), 6)))), 6)) AS INT) for v in a if v <> 0]] dig, "
    + ", ".join(f"[{fn}(a[i:i + {k - 1}]) for i in range(1, n + 1, {k})] y_{f}_{k}" for k in (5, 10, 50) for f, fn in _CHUNK.items()) + " FROM x),"
    " h AS (SELECT *, [log10(1 + 1 / d) for d in range(1, 10)] law, [len([t for t in dig if t = d]) / greatest(1, len(dig)) for d in range(1, 10)] seen FROM c)"
)
_BENFORD = "CASE WHEN list_var_pop(seen) > 0 THEN list_sum([(law[k] - list_avg(law)) * (seen[k] - list_avg(seen)) for k in range(1, 10)]) / 9 / (list_stddev_pop(law) * list_stddev_pop(seen)) END"
_LEVINSON = """, r AS (SELECT user_id, n, sd, [list_sum([(a[i] - m) * (a[i + k] - m) for i in range(1, n - k + 1)]) / (n - k) / (sd * sd) for k in range(0, least(41, n))] r FROM x),
    v AS (SELECT user_id, n, sd, r, CAST(0 AS BIGINT) k, CAST([] AS DOUBLE[]) c, [CAST(1 AS DOUBLE)] out FROM r
        UNION ALL SELECT user_id, n, sd, r, k + 1, [c[i] - l * c[k + 1 - i] for i in range(1, k + 1)] || [l], out || [l]
        FROM (SELECT *, (r[k + 2] - coalesce(list_sum([c[i] * r[k + 2 - i] for i in range(1, k + 1)]), 0)) / (1 - coalesce(list_sum([c[i] * r[i + 1] for i in range(1, k + 1)]), 0)) l FROM v WHERE k < least(9, n // 2 - 1))),
    p AS (SELECT user_id, any_value(n) n, any_value(sd) sd, any_value(r[2:]) lags, arg_max(out, k) out FROM v GROUP BY user_id)"""
_TWICE = "[v for v in a if len([w for w in a if w = v]) > 1]"
_SIGMAS = (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10)

#: Decimal places of results where not four: means of cents over a few values have halves there.
PLACES = {"feat_shape": 7}
#: Query name: (calculators, SQL, or none where SQL cannot say it).
SERIES: dict[str, tuple[tuple[str, ...], str | None]] = {
    "feat_peaks": (("number_peaks", "number_crossing_m"), _sql([
        *[(_name("number_peaks", n=p), _peaks(p)) for p in (1, 3, 5, 10, 50)],
        *[(_name("number_crossing_m", m=k), f"len([i for i in range(1, n) if (a[i] > {k}) <> (a[i + 1] > {k})])") for k in (0, -1, 1)],
    ])),
    "feat_autocorr": (("autocorrelation",), _sql([(_name("autocorrelation", lag=k), _autocorrelation(k)) for k in range(10)])),
    "feat_cid_c3": (("cid_ce", "c3", "time_reversal_asymmetry_statistic"), _sql([
        (_name("cid_ce", normalize=True), f"CASE WHEN sd > 0 THEN sqrt({_sum('power(a[i + 1] - a[i], 2)', '1', 'n')}) / sd ELSE 0 END"), (_name("cid_ce", normalize=False), f"sqrt({_sum('power(a[i + 1] - a[i], 2)', '1', 'n')})"),
        *[(_name("c3", lag=k), _lagged(k, "{z} * {y} * {x}")) for k in (1, 2, 3)],
        *[(_name("time_reversal_asymmetry_statistic", lag=k), _lagged(k, "{z} * {z} * {y} - {y} * {x} * {x}")) for k in (1, 2, 3)],
    ])),
    "feat_linear_trend": (("linear_trend",), _sql([*[(_name("linear_trend", attr=k), v) for k, v in _line("a").items()], (_name("linear_trend", attr="pvalue"), "p")], _T.replace("{r}", _line("a")["rvalue"]), "y")),
    "feat_fft": (("fft_coefficient", "fft_aggregated", "spkt_welch_density"), _sql([
        *[(_name("fft_coefficient", **p), _FFT[p["attr"]].replace("{k}", str(p["coeff"] + 1))) for p in PARAMETERS["fft_coefficient"]],
        *[(_name("fft_aggregated", **p), f"CASE WHEN tot > 0 THEN {_SPREAD[p['aggtype']]} END") for p in PARAMETERS["fft_aggregated"]],
        *[(_name("spkt_welch_density", **p), f"pd[{p['coeff'] + 1}]") for p in PARAMETERS["spkt_welch_density"]],
    ], _WAVES, "u")),
    "feat_entropy": (("sample_entropy", "approximate_entropy", "permutation_entropy", "binned_entropy", "fourier_entropy"), _sql([
        (_name("sample_entropy"), f"CASE WHEN n > 3 AND {_MATCH[0]} > 0 AND {_MATCH[1]} > 0 THEN -ln(({_MATCH[1]}) / ({_MATCH[0]})) END"),
        *[(_name("approximate_entropy", **p), f"CASE WHEN n <= 3 THEN 0 ELSE abs({_phi(2, p['r'])} - {_phi(3, p['r'])}) END") for p in PARAMETERS["approximate_entropy"]],
        *[(_name("permutation_entropy", **p), _permuted(p["dimension"])) for p in PARAMETERS["permutation_entropy"]],
        (_name("binned_entropy", max_bins=10), _binned("a", 10)),
        *[(_name("fourier_entropy", **p), f"CASE WHEN list_max(pd) > 0 THEN {_binned('pd', p['bins'])} END") for p in PARAMETERS["fourier_entropy"]],
    ], _WAVES, "u")),
    "feat_acf": (("partial_autocorrelation", "agg_autocorrelation"), _sql([
        *[(_name("partial_autocorrelation", lag=k), f"CASE WHEN n >= 4 AND sd >= 1e-12 THEN out[{k + 1}] END") for k in range(10)],
        *[(_name("agg_autocorrelation", **p), f"CASE WHEN n < 2 OR sd < 1e-12 THEN 0 ELSE {fn}(lags) END") for p, fn in zip(PARAMETERS["agg_autocorrelation"], ("list_avg", "list_median", "list_var_pop"), strict=True)],
    ], _LEVINSON, "p")),
    "feat_shape": (("cwt_coefficients", "change_quantiles", "agg_linear_trend", "benford_correlation", "index_mass_quantile", "energy_ratio_by_chunks"), _sql([
        *[(_name("cwt_coefficients", coeff=c, w=w, widths=WIDTHS), _hat(w, c)) for w in WIDTHS for c in range(15)],
        *[(_name("change_quantiles", f_agg=f, isabs=b, qh=hi, ql=lo), _changes(f, b, hi, lo)) for lo, hi in QUANTILE_PAIRS for b in (False, True) for f in ("mean", "var")],
        *[(_name("agg_linear_trend", **p), _line(f"y_{p['f_agg']}_{p['chunk_len']}")[p["attr"]]) for p in PARAMETERS["agg_linear_trend"]],
        (_name("benford_correlation"), _BENFORD),
        *[(_name("index_mass_quantile", **p), f"CASE WHEN mass > 0 THEN list_min([i for i in range(1, n + 1) if run[i] / mass >= {p['q']}]) / n END") for p in PARAMETERS["index_mass_quantile"]],
        *[(_name("energy_ratio_by_chunks", **p), f"CASE WHEN energy > 0 THEN coalesce(list_sum([v * v for v in a[{k} * (n // 10) + least({k}, n % 10) + 1:{k + 1} * (n // 10) + least({k + 1}, n % 10)]]), 0) / energy END") for k, p in enumerate(PARAMETERS["energy_ratio_by_chunks"])],
    ], _CHUNKS, "h", PLACES["feat_shape"])),
    "feat_more": (("mean_n_absolute_max", "ratio_beyond_r_sigma", "sum_of_reoccurring_data_points", "percentage_of_reoccurring_values_to_all_values", "has_duplicate_min"), _sql([
        (_name("mean_n_absolute_max", number_of_maxima=7), "CASE WHEN n >= 7 THEN list_avg(list_reverse_sort([abs(v) for v in a])[1:7]) END"),
        *[(name, f"len([v for v in a if abs(v - m) > {r}::DOUBLE * sd]) / n") for name, r in zip(map(plain_name, (f"somma__{k}" for k in ARRAYS["ratio_beyond_r_sigma"])), _SIGMAS, strict=True)],
        (_name("sum_of_reoccurring_data_points"), f"coalesce(list_sum({_TWICE}), 0)"), (_name("percentage_of_reoccurring_values_to_all_values"), f"len(list_distinct({_TWICE})) / len(list_distinct(a))"),
        (_name("has_duplicate_min"), "CASE WHEN len([v for v in a if v = lo]) >= 2 THEN 1 ELSE 0 END"),
    ])),
    # Recursive parsing, least squares over many columns and nearest windows: tested against plain Python instead.
    "feat_ar": (("ar_coefficient", "augmented_dickey_fuller"), None),
    "feat_profile": (("matrix_profile", "query_similarity_count", "friedrich_coefficients", "max_langevin_fixed_point", "lempel_ziv_complexity"), None),
}
