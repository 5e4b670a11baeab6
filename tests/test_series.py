import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lunario.functions import stats
from lunario.functions.series import arrays
from lunario.operators.bucketing import TimeBucketing
from lunario.operators.features import FeatureGenerating, clean_names
from lunario.operators.filling import Filling
from lunario.operators.pruning import FeaturePruning

MOMENTS = ["2023-04-16 01:00:00", "2023-04-16 23:59:59.5", "2023-12-31 23:59:59", "2024-02-29 12:00:00", "2024-03-26 02:00:00", "2023-05-01 00:00:00", "2023-04-17 00:00:00"]


@pytest.fixture(scope="module")
def timed(spark):
    return spark.createDataFrame([(k % 3, t, float(k)) for k, t in enumerate([*MOMENTS, None])], "id int, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))


@pytest.mark.parametrize("unit", ["hour", "days", "w", "month", "years"])
@pytest.mark.parametrize("size", [1, 2, 3, 8, 12])
def test_buckets_contain_their_rows_and_tile_time(timed, unit, size):
    step = TimeBucketing("t", size, unit)
    line = [tuple(r) for r in step.timeline(timed).orderBy("bucket_start").collect()]
    rows = step(timed).collect()
    assert len(rows) == len(MOMENTS)
    for a, b in zip(line, line[1:], strict=False):
        assert a[1] + dt.timedelta(seconds=1) == b[0]
    for r in rows:
        assert r.bucket_start <= r.t < r.bucket_end + dt.timedelta(seconds=1)
        assert (r.bucket_start, r.bucket_end) in line
    first = {"h": dt.datetime(2023, 4, 16, 1), "d": dt.datetime(2023, 4, 16), "w": dt.datetime(2023, 4, 10), "m": dt.datetime(2023, 4, 1), "y": dt.datetime(2023, 1, 1)}
    assert line[0][0] == first[unit[0]]


def test_the_sessions_zone_does_not_matter(spark):
    times = ["2023-03-26 01:59:59", "2023-03-26 02:00:00", "2023-03-26 02:30:00", "2023-03-26 03:10:00", "2023-10-29 02:30:00", "1969-12-30 23:30:00.5"]
    df = spark.createDataFrame([(t,) for t in times], "t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    seen = []
    try:
        for zone in ("UTC", "Europe/Rome", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [TimeBucketing("t", 1, unit)(df).selectExpr("cast(t as string) t", "cast(bucket_start as string) s", "cast(bucket_end as string) e").collect() for unit in "hdwmy"]
            seen.append([sorted(g) for g in got])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert seen[0] == seen[1] == seen[2]
    assert ("2023-03-26 02:30:00", "2023-03-26 02:00:00", "2023-03-26 02:59:59") in [tuple(r) for r in seen[0][0]]
    assert ("1969-12-30 23:30:00.5", "1969-12-29 00:00:00", "1970-01-04 23:59:59") in [tuple(r) for r in seen[0][2]]


@pytest.mark.parametrize("size", [-2, "2", 2.0, 0, True])
def test_sizes_must_be_whole_and_positive(size):
    with pytest.raises(ValueError):
        TimeBucketing("t", size, "day")


def test_bucketing_errors(spark, timed):
    with pytest.raises(ValueError, match="not supported"):
        TimeBucketing("t", 1, "x")
    with pytest.raises(ValueError, match="is not a timestamp column"):
        TimeBucketing("v", 1, "d")(timed)
    with pytest.raises(ValueError, match="is not present"):
        TimeBucketing("z", 1, "d")(timed)
    with pytest.raises(ValueError, match="Empty DataFrame"):
        TimeBucketing("t", 1, "d")(timed.where("false"))


def test_filling(bucketed):
    one = bucketed.groupBy("ID_BIC_CLIENTE", "bucket_start", "bucket_end").agg(F.sum("IMPORTO").alias("s"), F.max("CA_CATEGORY_LIV0").alias("c"))
    rows = Filling(["ID_BIC_CLIENTE"], TimeBucketing("bucket_start", 1, "day"))(one).orderBy("bucket_start").collect()
    first = [r for r in rows if r.ID_BIC_CLIENTE == 348272371]
    assert [(r.bucket_start.day, r.s) for r in first] == [(1, 213), (2, 0), (3, 0), (4, 0), (5, 0), (6, 1354)]
    assert [r.c for r in first] == ["trasporti", None, None, None, None, "shopping"] and len(rows) == 8


SERIES = [1.0, 3.0, 2.0, 2.0, 5.0, 0.0, 4.0, 4.0, 1.0, 7.0]


def test_features_against_plain_python(spark):
    start = dt.datetime(2023, 1, 1)
    rows = [(1, start + dt.timedelta(days=k), v) for k, v in enumerate(SERIES)] + [(2, start, 5.0), (3, start, None)]
    df = spark.createDataFrame(rows[::-1], "id int, t timestamp_ntz, s double")
    out = {r.id: r.asDict() for r in FeatureGenerating("id", "t", drop_nulls=False)(df).collect()}
    got, x, n = out[1], np.array(SERIES), len(SERIES)
    d = np.diff(x)
    plain = {
        "sum_values": x.sum(), "abs_energy": x @ x, "mean": x.mean(), "median": np.median(x), "standard_deviation": x.std(), "count_above_mean": (x > x.mean()).sum(), "absolute_sum_of_changes": np.abs(d).sum(),
        "mean_change": (x[-1] - x[0]) / (n - 1), "mean_second_derivative_central": (x[-1] - x[-2] - x[1] + x[0]) / (2 * (n - 2)), "first_location_of_maximum": 0.9, "last_location_of_minimum": 0.6,
        "quantile__q_0dot3": np.quantile(x, 0.3), "number_peaks__n_1": 2, "c3__lag_1": np.mean(x[2:] * x[1:-1] * x[:-2]), "time_reversal_asymmetry_statistic__lag_2": np.mean(x[4:] ** 2 * x[2:-2] - x[2:-2] * x[:-4] ** 2),
        "autocorrelation__lag_2": ((x[2:] - x.mean()) * (x[:-2] - x.mean())).sum() / ((n - 2) * x.var()), "cid_ce__normalize_False": math.sqrt(d @ d), "longest_strike_above_mean": 2, "longest_strike_below_mean": 2,
        "sum_of_reoccurring_values": 1 + 2 + 4, "sum_of_reoccurring_data_points": 2 + 4 + 8, "percentage_of_reoccurring_datapoints_to_all_datapoints": 0.6, "has_duplicate_max": 0, "number_crossing_m__m_1": 5,
        "linear_trend__attr_slope": np.polyfit(range(n), x, 1)[0], "fft_coefficient__attr_abs__coeff_1": abs(np.fft.rfft(x)[1]), "binned_entropy__max_bins_10": -sum(p * math.log(p) for p in np.histogram(x, 10)[0] / n if p),
        "mean_n_absolute_max__number_of_maxima_7": np.sort(x)[-7:].mean(), "ratio_beyond_r_sigma__r_1": (np.abs(x - x.mean()) > x.std()).mean(),
    }
    for name, value in plain.items():
        assert got[f"s__{name}"] == pytest.approx(float(value)), name
    assert out[2]["s__mean"] == 5 and out[2]["s__skewness"] is None and out[3]["s__length"] == 0 and out[3]["s__mean"] is None


def test_feature_errors_and_names(spark):
    df = spark.createDataFrame([(1, dt.datetime(2023, 1, 1), "x")], "id int, t timestamp_ntz, agg1 string")
    with pytest.raises(ValueError, match="Column agg1 is not a numerical column"):
        FeatureGenerating("id", "t")(df)
    with pytest.raises(ValueError, match="Feature calculator benford_correlation_typo is not supported"):
        FeatureGenerating("id", "t", feature_calculators=["benford_correlation_typo"])(df)
    assert clean_names(spark.range(1).selectExpr("id as `a__p_0.0`")).columns == ["a__p_0dot0"]


def test_representative_values_and_null_columns(spark):
    rows = [(1, dt.datetime(2023, 1, 2), 2.0, 20), (1, dt.datetime(2023, 1, 1), 1.0, 10), (2, dt.datetime(2023, 1, 1), 1.0, 30)]
    df = spark.createDataFrame(rows, "id int, t timestamp_ntz, s double, eta int")
    out = FeatureGenerating("id", "t", ["eta"], ["mean", "mean_change"])(df)
    assert sorted(out.columns) == ["eta", "id", "s__mean"] and {r.id: r.eta for r in out.collect()} == {1: 10, 2: 30}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=0, max_size=60))
def test_numpy_tier_never_fails(values):
    names = list(arrays.PARAMETERS)
    assert len(arrays.evaluate(np.array(values, float), names)) == sum(len(p) for p in arrays.PARAMETERS.values())


def test_relevance_goldens(spark):
    rows = [(i, i + 3.2, 2 * (i + 3.2), float(i % 2), float(i % 3)) for i in range(1000)]
    df = spark.createDataFrame(rows, "ID_CLIENTE_BIC int, TARGET double, ft1 double, ft2 double, ft3 double")
    kept, table = FeaturePruning("ID_CLIENTE_BIC", "TARGET")(df)
    got = {r.feature: (r.type, r.p_value, r.relevant) for r in table.collect()}
    assert got == {"ft1": ("real", 0.0, True), "ft3": ("real", 0.9732849094549185, False), "ft2": ("binary", 0.9999999999999998, False)}
    assert kept.columns == ["ID_CLIENTE_BIC", "TARGET", "ft1"]
    with pytest.raises(ValueError, match=r"Columns \['ft1'\] of DataFrame must not contain NaN values"):
        FeaturePruning("ID_CLIENTE_BIC", "TARGET")(df.withColumn("ft1", F.when(F.col("ft1") > 10, F.col("ft1"))))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), min_size=3, max_size=40))
def test_kendall_counts_pairs(pairs):
    x, y = (np.array(v, float) for v in zip(*pairs, strict=True))
    score = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
    p = stats.kendall(x, y, np.ones(len(x)))
    assert 0 <= p <= 1 and (score != 0 or p == 1)
    values, counts = np.unique(np.array(pairs), axis=0, return_counts=True)
    assert stats.kendall(values[:, 0].astype(float), values[:, 1].astype(float), counts.astype(float)) == pytest.approx(p)


def test_distributions():
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.fisher(8, 2, 1, 5) == pytest.approx(0.03496503, abs=1e-7)
    assert stats.false_discovery(np.array([0.001, 0.9, 0.002])).tolist() == [True, False, True]
