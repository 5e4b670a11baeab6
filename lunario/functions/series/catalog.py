"""The calculators that are offered, with their tier, parameters and tags, as data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lunario.functions.series.arrays import PARAMETERS
from lunario.functions.series.sql import AGGREGATES, ARRAYS

#: Tags, each with the calculators that carry it.
TAGS = {
    "pattern": "number_peaks number_crossing_m fft_coefficient fft_aggregated fourier_entropy spkt_welch_density cwt_coefficients matrix_profile autocorrelation partial_autocorrelation agg_autocorrelation ar_coefficient c3 time_reversal_asymmetry_statistic query_similarity_count",
    "redundancy": "ratio_value_number_to_time_series_length sum_of_reoccurring_values sum_of_reoccurring_data_points percentage_of_reoccurring_datapoints_to_all_datapoints percentage_of_reoccurring_values_to_all_values has_duplicate has_duplicate_max has_duplicate_min",
    "regularity": "permutation_entropy sample_entropy approximate_entropy binned_entropy lempel_ziv_complexity cid_ce change_quantiles benford_correlation augmented_dickey_fuller energy_ratio_by_chunks",
    "counting": "count_above count_above_mean count_below count_below_mean range_count value_count length longest_strike_above_mean longest_strike_below_mean",
    "averages": "mean median quantile root_mean_square mean_abs_change mean_change mean_second_derivative_central mean_n_absolute_max absolute_sum_of_changes index_mass_quantile",
    "basics": "sum_values absolute_maximum minimum maximum standard_deviation variance variation_coefficient skewness kurtosis abs_energy symmetry_looking large_standard_deviation variance_larger_than_standard_deviation ratio_beyond_r_sigma first_location_of_maximum last_location_of_maximum first_location_of_minimum last_location_of_minimum",
    "trend": "friedrich_coefficients max_langevin_fixed_point linear_trend agg_linear_trend augmented_dickey_fuller longest_strike_above_mean longest_strike_below_mean",
}


def tier(name: str) -> str | None:
    return "A" if name in AGGREGATES else "B" if name in ARRAYS else "C" if name in PARAMETERS else None


def names() -> list[str]:
    return [*AGGREGATES, *ARRAYS, *PARAMETERS]


def width(name: str) -> int:
    """How many columns a calculator gives for each series column."""
    return len(AGGREGATES.get(name) or ARRAYS.get(name) or PARAMETERS[name])


def catalog(spark: SparkSession, tag: str | None = None, feature: str | None = None) -> DataFrame:
    """Without arguments the tags; with a tag its calculators; with the beginning of a name the calculators of that name."""
    if tag is None and feature is None:
        return spark.createDataFrame([(t, len(v.split())) for t, v in TAGS.items()], "tag string, calculators int")
    if tag is not None:
        if tag not in TAGS:
            raise ValueError(f"Tag {tag} is not known")
        chosen = TAGS[tag].split()
    else:
        chosen = [n for n in names() if n.startswith(feature)]
    rows = [(n, tier(n), width(n), [t for t, v in TAGS.items() if n in v.split()]) for n in chosen]
    return spark.createDataFrame(rows, "feature string, tier string, columns int, tags array<string>")
