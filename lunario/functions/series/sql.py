"""Tiers A and B: calculators that stay in the JVM.

Tier A is a plain aggregate of the value column. Tier B is an expression over the time-ordered array of a series and
the aggregates in ``BASE``; ``{a}``, ``{d}``, ``{n}``, ``{mean}``, ``{sd}``, ``{lo}`` and ``{hi}`` stand for the array, its
differences, its length, mean, population deviation, least and greatest value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = [round(0.05 * k, 2) for k in range(20)]
#: Whole-series aggregates that the expressions of tier B use.
BASE: dict[str, Callable[[Column], Column]] = {
    "n": F.count, "mean": F.avg, "sd": F.stddev_pop, "lo": F.min, "hi": F.max, "med": F.median, "sum": F.sum, "sq": lambda v: F.sum(v * v),
}


def label(calculator: str, **params) -> str:
    """``calculator__param_value`` with parameters by name."""
    return "__".join([calculator, *(f"{k}_" + (f'"{v}"' if isinstance(v, str) else str(v)) for k, v in sorted(params.items()))])


def _flag(c: Column) -> Column:
    return c.cast("double")


def _aggregates() -> dict[str, dict[str, Callable[[Column], Column]]]:
    n = F.count
    share = lambda c: F.avg(c.cast("double"))
    within = lambda lo, hi: lambda v: F.count_if((v >= lo) & (v < hi)).cast("double")
    return {
        "count_above": {label("count_above", t=0): lambda v: share(v >= 0)},
        "count_below": {label("count_below", t=0): lambda v: share(v <= 0)},
        "range_count": {label("range_count", max=hi, min=lo): within(lo, hi) for lo, hi in ((-1, 1), (-1e12, 0), (0, 1e12))},
        "value_count": {label("value_count", value=x): (lambda x: lambda v: F.count_if(v == x).cast("double"))(x) for x in (0, 1, -1)},
        "sum_values": {"sum_values": F.sum},
        "absolute_maximum": {"absolute_maximum": lambda v: F.max(F.abs(v))},
        "length": {"length": lambda v: n(v).cast("double")},
        "mean": {"mean": F.avg},
        "median": {"median": F.median},
        "minimum": {"minimum": F.min},
        "maximum": {"maximum": F.max},
        "quantile": {label("quantile", q=q): (lambda q: lambda v: F.percentile(v, q))(q) for q in (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)},
        "root_mean_square": {"root_mean_square": lambda v: F.sqrt(F.avg(v * v))},
        "standard_deviation": {"standard_deviation": F.stddev_pop},
        "variance": {"variance": F.var_pop},
        "variation_coefficient": {"variation_coefficient": lambda v: F.try_divide(F.stddev_pop(v), F.avg(v))},
        "ratio_value_number_to_time_series_length": {"ratio_value_number_to_time_series_length": lambda v: F.try_divide(F.count_distinct(v).cast("double"), n(v))},
        "has_duplicate": {"has_duplicate": lambda v: _flag(F.count_distinct(v) < n(v))},
        "symmetry_looking": {label("symmetry_looking", r=r): (lambda r: lambda v: _flag(F.abs(F.avg(v) - F.median(v)) < r * (F.max(v) - F.min(v))))(r) for r in STEPS},
        "large_standard_deviation": {label("large_standard_deviation", r=r): (lambda r: lambda v: _flag(F.stddev_pop(v) > r * (F.max(v) - F.min(v))))(r) for r in STEPS[1:]},
        "variance_larger_than_standard_deviation": {"variance_larger_than_standard_deviation": lambda v: _flag(F.var_pop(v) > F.stddev_pop(v))},
        "skewness": {"skewness": lambda v: F.when(n(v) > 2, F.skewness(v) * F.sqrt(n(v) * (n(v) - 1)) / (n(v) - 2))},
        "kurtosis": {"kurtosis": lambda v: F.when(n(v) > 3, (n(v) - 1) / ((n(v) - 2) * (n(v) - 3)) * ((n(v) + 1) * F.kurtosis(v) + 6))},
        "abs_energy": {"abs_energy": lambda v: F.sum(v * v)},
    }


def _total(array: str) -> str:
    return f"aggregate({array}, 0D, (s, v) -> s + v)"


def _shifted(array: str, lag: int) -> tuple[str, str]:
    """(all but the first ``lag``, all but the last ``lag``) of an array."""
    return f"slice({array}, {lag + 1}, greatest({{n}} - {lag}, 0))", f"slice({array}, 1, greatest({{n}} - {lag}, 0))"


def _lagged_mean(lag: int, of: str) -> str:
    """Mean over i of an expression of x[i], x[i+lag], x[i+2 lag]; 0 if the series is too short."""
    rows = f"transform(sequence(1, {{n}} - {2 * lag}), i -> {of.format(x='{a}[i - 1]', y=f'{{a}}[i + {lag - 1}]', z=f'{{a}}[i + {2 * lag - 1}]')})"
    return f"CASE WHEN {{n}} > {2 * lag} THEN {_total(rows)} / ({{n}} - {2 * lag}) ELSE 0D END"


def _run(sign: str) -> str:
    return (
        f"aggregate({{a}}, named_struct('c', 0, 'm', 0), (s, v) -> named_struct('c', IF(v {sign} {{mean}}, s.c + 1, 0), 'm', greatest(s.m, IF(v {sign} {{mean}}, s.c + 1, 0))), s -> CAST(s.m AS DOUBLE))"
    )


def _peaks(n: int) -> str:
    near = f"forall(sequence(1, {n}), k -> {{a}}[i - 1] > {{a}}[i - 1 - k] AND {{a}}[i - 1] > {{a}}[i - 1 + k])"
    return f"CASE WHEN {{n}} > {2 * n} THEN CAST(size(filter(sequence({n + 1}, {{n}} - {n}), i -> {near})) AS DOUBLE) ELSE 0D END"


def _autocorrelation(lag: int) -> str:
    if lag == 0:
        return "CASE WHEN {sd} > 0 THEN 1D END"
    later, earlier = _shifted("{a}", lag)
    return f"CASE WHEN {{sd}} > 1e-12 AND {{n}} > {lag} THEN {_total(f'zip_with({later}, {earlier}, (p, q) -> (p - {{mean}}) * (q - {{mean}}))')} / (({{n}} - {lag}) * {{sd}} * {{sd}}) END"


_REPEATED = "filter(array_distinct({a}), v -> size(filter({a}, w -> w = v)) > 1)"
ARRAYS: dict[str, dict[str, str]] = {
    "count_above_mean": {"count_above_mean": "CAST(size(filter({a}, v -> v > {mean})) AS DOUBLE)"},
    "count_below_mean": {"count_below_mean": "CAST(size(filter({a}, v -> v < {mean})) AS DOUBLE)"},
    "number_peaks": {label("number_peaks", n=n): _peaks(n) for n in (1, 3, 5, 10, 50)},
    "number_crossing_m": {label("number_crossing_m", m=m): "CAST(size(filter(zip_with({}, {}, (p, q) -> (p > {m}) <> (q > {m})), b -> b)) AS DOUBLE)".replace("{}", _shifted("{a}", 1)[0], 1).replace("{}", _shifted("{a}", 1)[1], 1).replace("{m}", str(m)) for m in (0, -1, 1)},
    "first_location_of_maximum": {"first_location_of_maximum": "(array_position({a}, {hi}) - 1) / {n}"},
    "last_location_of_maximum": {"last_location_of_maximum": "1 - (array_position(reverse({a}), {hi}) - 1) / {n}"},
    "first_location_of_minimum": {"first_location_of_minimum": "(array_position({a}, {lo}) - 1) / {n}"},
    "last_location_of_minimum": {"last_location_of_minimum": "1 - (array_position(reverse({a}), {lo}) - 1) / {n}"},
    "sum_of_reoccurring_values": {"sum_of_reoccurring_values": _total(_REPEATED)},
    "sum_of_reoccurring_data_points": {"sum_of_reoccurring_data_points": _total("filter({a}, v -> size(filter({a}, w -> w = v)) > 1)")},
    "percentage_of_reoccurring_datapoints_to_all_datapoints": {"percentage_of_reoccurring_datapoints_to_all_datapoints": "size(filter({a}, v -> size(filter({a}, w -> w = v)) > 1)) / {n}"},
    "percentage_of_reoccurring_values_to_all_values": {"percentage_of_reoccurring_values_to_all_values": f"size({_REPEATED}) / size(array_distinct({{a}}))"},
    "has_duplicate_max": {"has_duplicate_max": "CAST(size(filter({a}, v -> v = {hi})) >= 2 AS DOUBLE)"},
    "has_duplicate_min": {"has_duplicate_min": "CAST(size(filter({a}, v -> v = {lo})) >= 2 AS DOUBLE)"},
    "mean_second_derivative_central": {"mean_second_derivative_central": "CASE WHEN {n} > 2 THEN ({a}[{n} - 1] - {a}[{n} - 2] - {a}[1] + {a}[0]) / (2 * ({n} - 2)) END"},
    "mean_abs_change": {"mean_abs_change": f"CASE WHEN {{n}} > 1 THEN {_total('transform({d}, v -> abs(v))')} / ({{n}} - 1) END"},
    "mean_change": {"mean_change": "CASE WHEN {n} > 1 THEN ({a}[{n} - 1] - {a}[0]) / ({n} - 1) END"},
    "absolute_sum_of_changes": {"absolute_sum_of_changes": _total("transform({d}, v -> abs(v))")},
    "time_reversal_asymmetry_statistic": {label("time_reversal_asymmetry_statistic", lag=k): _lagged_mean(k, "{z} * {z} * {y} - {y} * {x} * {x}") for k in (1, 2, 3)},
    "c3": {label("c3", lag=k): _lagged_mean(k, "{z} * {y} * {x}") for k in (1, 2, 3)},
    "autocorrelation": {label("autocorrelation", lag=k): _autocorrelation(k) for k in range(10)},
    "cid_ce": {
        label("cid_ce", normalize=True): f"CASE WHEN {{sd}} > 0 THEN sqrt({_total('transform({d}, v -> v * v)')}) / {{sd}} ELSE 0D END",
        label("cid_ce", normalize=False): f"sqrt({_total('transform({d}, v -> v * v)')})",
    },
    "longest_strike_above_mean": {"longest_strike_above_mean": _run(">")},
    "longest_strike_below_mean": {"longest_strike_below_mean": _run("<")},
    "mean_n_absolute_max": {label("mean_n_absolute_max", number_of_maxima=7): f"CASE WHEN {{n}} >= 7 THEN {_total('slice(reverse(array_sort(transform({a}, v -> abs(v)))), 1, 7)')} / 7 END"},
    "ratio_beyond_r_sigma": {label("ratio_beyond_r_sigma", r=r): f"size(filter({{a}}, v -> abs(v - {{mean}}) > {r} * {{sd}})) / {{n}}" for r in (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10)},
}
AGGREGATES = _aggregates()
