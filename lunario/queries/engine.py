"""Queries of the engine itself: buckets, aggregates, filling, features, relevance, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lunario.functions.predicates import AndGroup, Filter, OrGroup
from lunario.functions.series.catalog import catalog
from lunario.operators.aggregating import Aggregating, Aggregation, Pivot
from lunario.operators.bucketing import TimeBucketing
from lunario.operators.features import FeatureGenerating, drop_null_columns, unpivot_series
from lunario.operators.filling import Filling
from lunario.operators.pruning import FeaturePruning
from lunario.operators.sampling import random_split, sample_rows, sample_series, stratified_histogram, stratified_split, value_buckets
from lunario.plans.model import TrainingHelper, label_encode, one_hot_encode
from lunario.plans.pipeline import build
from lunario.queries.series import PLACES, SERIES
from lunario.sources.tables import table
from lunario.streaming.windows import streaming_buckets

EDGES = ["bucket_start", "bucket_end"]
GRANULARITIES = {"hour": "h", "day": "d", "week": "w", "month": "m", "year": "y"}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "user_id", "ts", "event_type", "value")


def _weekly(spark: SparkSession, d: str) -> DataFrame:
    return TimeBucketing("ts", 1, "week")(_events(spark, d))


# Buckets ------------------------------------------------------------------------------------------------------------
def _bucket(source: str, key: str, time: str, size: int, unit: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        b = TimeBucketing(time, size, unit)(table(spark, d, source, key, time))
        return b.groupBy(*EDGES).agg(F.count("*").alias("n"), F.min(time).cast("timestamp_ntz").alias("first_t"), F.max(time).cast("timestamp_ntz").alias("last_t"))

    return query


def _bucket_sql(source: str, time: str, size: int, unit: str) -> str:
    step = {"hour": f"INTERVAL {size} HOUR", "day": f"INTERVAL {size} DAY", "week": f"INTERVAL {7 * size} DAY", "month": f"INTERVAL {size} MONTH", "year": f"INTERVAL {size} YEAR"}[unit]
    return f"""WITH o AS (SELECT CAST(date_trunc('{unit}', min({time})) AS TIMESTAMP) lo, CAST(max({time}) AS TIMESTAMP) hi FROM {source}),
        b AS (SELECT unnest(generate_series(lo, hi, {step})) AS s FROM o)
        SELECT s AS bucket_start, s + {step} - INTERVAL 1 SECOND AS bucket_end, count(*) AS n, CAST(min({time}) AS TIMESTAMP) AS first_t, CAST(max({time}) AS TIMESTAMP) AS last_t
        FROM b JOIN {source} ON {time} >= s AND {time} < s + {step} GROUP BY s"""


for _size, _unit in ((1, "hour"), (1, "day"), (1, "week"), (3, "hour"), (2, "day"), (2, "week")):
    register(f"bucket_{_size if _size > 1 else ''}{_unit}", _bucket("events", "user_id", "ts", _size, _unit), _bucket_sql("events", "ts", _size, _unit))
for _size, _unit in ((1, "month"), (1, "year"), (3, "month"), (2, "year")):
    register(f"bucket_{_size if _size > 1 else ''}{_unit}", _bucket("lineitem", "l_suppkey", "l_shipdate", _size, _unit), _bucket_sql("lineitem", "l_shipdate", _size, _unit))

register(
    "bucket_timeline",
    lambda s, d: TimeBucketing("ts", 1, "week").timeline(_events(s, d)),
    "WITH o AS (SELECT CAST(date_trunc('week', min(ts)) AS TIMESTAMP) lo, max(ts) hi FROM events), b AS (SELECT unnest(generate_series(lo, hi, INTERVAL 7 DAY)) s FROM o) SELECT s AS bucket_start, s + INTERVAL 7 DAY - INTERVAL 1 SECOND AS bucket_end FROM b",
)

# Aggregates ---------------------------------------------------------------------------------------------------------
_W = """WITH o AS (SELECT date_trunc('week', min(ts)) lo FROM events),
    w AS (SELECT e.user_id, e.event_type, e.value, e.ts, CAST(lo AS TIMESTAMP) + to_days(CAST(7 * (date_diff('day', CAST(lo AS TIMESTAMP), date_trunc('day', ts)) // 7) AS INTEGER)) AS bucket_start FROM events e, o)"""
_KEYS = "user_id, bucket_start, bucket_start + INTERVAL 7 DAY - INTERVAL 1 SECOND AS bucket_end"


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles to some places, means to nine: sums of cents have no halves there, whichever order they are added in."""
    return df.select(*[F.round(F.col(f"`{n}`"), 9 if n.startswith("avg") else places).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes])


def _aggregated(*aggregations: Aggregation):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _rounded(Aggregating(["user_id"], EDGES, list(aggregations), order_by="ts")(_weekly(spark, d)))

    return query


def _aggregated_sql(*columns: tuple[str, str]) -> str:
    """Columns: (SQL, name)."""
    return f"{_W} SELECT {_KEYS}, " + ", ".join(f'{sql} AS "{name}"' for sql, name in columns) + " FROM w GROUP BY user_id, bucket_start"


_SQL_AGG = {"sum": "round(sum(value), 4)", "count": "count(value)", "avg": "round(avg(value), 9)", "min": "round(min(value), 4)", "max": "round(max(value), 4)"}
for _fn, _text in _SQL_AGG.items():
    register(f"agg_{_fn}", _aggregated(Aggregation("value", _fn)), _aggregated_sql((_text, f"{_fn}(value)")))
def _first_last(spark: SparkSession, d: str) -> DataFrame:
    return Aggregating(["user_id"], EDGES, [Aggregation("value", "first"), Aggregation("value", "last", [Filter("event_type", "=", "click")])], order_by="ts")(_weekly(spark, d))


register("agg_first_last", _first_last, _aggregated_sql(("arg_min(value, ts)", "first(value)"), ("arg_max(value, ts) FILTER (event_type = 'click')", "last(value)_where_event_type=click")))


_FILTERS = {
    "eq": (Filter("event_type", "=", "click"), "event_type = 'click'", "event_type=click"),
    "ne": (Filter("event_type", "!=", "click"), "event_type <> 'click'", "event_type!=click"),
    "lt": (Filter("value", "<", 20), "value < 20", "value<20"),
    "le": (Filter("value", "<=", 20.5), "value <= 20.5", "value<=20.5"),
    "gt": (Filter("value", ">", 20), "value > 20", "value>20"),
    "ge": (Filter("value", ">=", 20.5), "value >= 20.5", "value>=20.5"),
    "in": (Filter("event_type", "in", ["click", "view"]), "event_type IN ('click', 'view')", "event_type[click_view]"),
    "notin": (Filter("event_type", "not in", ["click", "view"]), "event_type NOT IN ('click', 'view')", "event_type[click_view]"),
    "and": (AndGroup([Filter("event_type", "=", "view"), Filter("value", ">", 5)]), "(event_type = 'view' AND value > 5)", "(event_type=view&value>5)"),
    "or": (OrGroup([Filter("event_type", "=", "view"), Filter("value", ">", 50)]), "(event_type = 'view' OR value > 50)", "(event_type=view|value>50)"),
    "nested": (OrGroup([AndGroup([Filter("event_type", "in", ["error", "signup"]), Filter("value", "<", 30)]), Filter("value", ">=", 100)]), "((event_type IN ('error', 'signup') AND value < 30) OR value >= 100)", "((event_type[error_signup]&value<30)|value>=100)"),
}
for _key, (_filter, _where, _label) in _FILTERS.items():
    register(
        f"filter_{_key}",
        _aggregated(Aggregation("value", "sum", [_filter]), Aggregation("value", "count", [_filter])),
        _aggregated_sql((f"round(sum(value) FILTER ({_where}), 4)", f"sum(value)_where_{_label}"), (f"count(value) FILTER ({_where})", f"count(value)_where_{_label}")),
    )

_TYPES = ("click", "error", "purchase", "signup", "view")


def _cell(fn: str, where: str) -> str:
    return f"CASE WHEN count(*) FILTER ({where}) > 0 THEN count(value) FILTER ({where}) END" if fn == "count" else f"round({fn}(value) FILTER ({where}), {9 if fn == 'avg' else 4})"


register("pivot_explicit", _aggregated(Aggregation("value", "sum", pivot=Pivot("event_type", "=", ["view", "click"]))), _aggregated_sql(*[(_cell("sum", f"event_type = '{t}'"), f"sum(value)_where_event_type={t}") for t in ("view", "click")]))
register("pivot_discovered", _aggregated(Aggregation("value", "max", pivot=Pivot("event_type"))), _aggregated_sql(*[(_cell("max", f"event_type = '{t}'"), f"max(value)_where_event_type={t}") for t in _TYPES]))
register("pivot_filtered", _aggregated(Aggregation("value", "avg", [Filter("value", ">", 10)], Pivot("event_type", "=", ["view", "click"]))), _aggregated_sql(*[(_cell("avg", f"value > 10 AND event_type = '{t}'"), f"avg(value)_where_value>10_event_type={t}") for t in ("view", "click")]))
register("pivot_count_null", _aggregated(Aggregation("value", "count", pivot=Pivot("event_type"))), _aggregated_sql(*[(_cell("count", f"event_type = '{t}'"), f"count(value)_where_event_type={t}") for t in _TYPES]))
register(
    "multi_agg",
    _aggregated(Aggregation("value", "sum"), Aggregation("value", "avg", [Filter("event_type", "=", "view")]), Aggregation("value", "count", pivot=Pivot("event_type", "=", ["error"])), Aggregation("value", "min", [Filter("value", ">", 1)])),
    _aggregated_sql(("round(sum(value), 4)", "sum(value)"), ("round(avg(value) FILTER (event_type = 'view'), 9)", "avg(value)_where_event_type=view"), (_cell("count", "event_type = 'error'"), "count(value)_where_event_type=error"), ("round(min(value) FILTER (value > 1), 4)", "min(value)_where_value>1")),
)
register(
    "naming_pattern",
    _aggregated(Aggregation("value", "sum", [Filter("value", ">", 1, "grande")], Pivot("event_type", "=", ["view"], "tipo_PIVOTVALUE"), "FUNCTION_NUMERICAL_FILTERS_PIVOT"), Aggregation("value", "max", pivot=Pivot("event_type", "=", ["click"]), new_col_name="massimo")),
    _aggregated_sql(("round(sum(value) FILTER (value > 1 AND event_type = 'view'), 4)", "sum_value_grande_tipo_view"), ("round(max(value) FILTER (event_type = 'click'), 4)", "massimo_event_type=click")),
)

# Filling and chains -------------------------------------------------------------------------------------------------
_FILLED = f"""{_W}, a AS (SELECT user_id, bucket_start, sum(value) s, count(value) FILTER (event_type = 'click') c FROM w GROUP BY 1, 2),
    b AS (SELECT user_id, min(bucket_start) lo, max(bucket_start) hi FROM a GROUP BY 1),
    g AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 7 DAY)) bucket_start FROM b),
    f AS (SELECT g.user_id, g.bucket_start, coalesce(a.s, 0) s, coalesce(a.c, 0) c FROM g LEFT JOIN a USING (user_id, bucket_start))"""


def _filled(spark: SparkSession, d: str, unit: str = "week") -> DataFrame:
    step = TimeBucketing("ts", 1, unit)
    a = Aggregating(["user_id"], EDGES, [Aggregation("value", "sum", new_col_name="somma"), Aggregation("value", "count", [Filter("event_type", "=", "click")], new_col_name="click")])(step(_events(spark, d)))
    return Filling(["user_id"], step)(a)


register("fill_gaps", lambda s, d: _rounded(_filled(s, d)), f"{_FILLED} SELECT {_KEYS}, round(s, 4) AS somma, c AS click FROM f")
_CONFIG = {
    "ids": ["user_id"], "time": "ts", "bucket": {"size": 1, "granularity": "week"},
    "aggregations": [{"col": "value", "fn": "sum", "name": "somma"}, {"col": "value", "fn": "count", "name": "click", "filters": [{"col": "event_type", "op": "=", "value": "click"}]}],
}
register("pipeline_full", lambda s, d: _rounded(build(_CONFIG)(_events(s, d))), f"{_FILLED} SELECT {_KEYS}, round(s, 4) AS somma, c AS click FROM f")
register(
    "unpivot_series",
    lambda s, d: unpivot_series(_filled(s, d).drop("bucket_end"), "user_id", "bucket_start").withColumn("value", F.round("value", 4)),
    f"{_FILLED} SELECT user_id, bucket_start, 'somma' AS kind, round(s, 4) AS value FROM f UNION ALL SELECT user_id, bucket_start, 'click', CAST(c AS DOUBLE) FROM f",
)
register("drop_null_columns", lambda s, d: drop_null_columns(table(s, d, "events", "user_id").distinct().withColumns({"sempre": F.lit(1), "mai": F.when(F.col("user_id") > 5, 1)})), "SELECT DISTINCT user_id, 1 AS sempre FROM events")

# Features -----------------------------------------------------------------------------------------------------------


def _features(*calculators: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        series = _filled(spark, d).select("user_id", "bucket_start", "somma")
        out = FeatureGenerating("user_id", "bucket_start", feature_calculators=list(calculators), drop_nulls=False)(series)
        return _rounded(out)

    return query


_SERIES = f"""{_FILLED}, x AS (SELECT user_id, s v, row_number() OVER (PARTITION BY user_id ORDER BY bucket_start) i, count(*) OVER (PARTITION BY user_id) n,
        avg(s) OVER (PARTITION BY user_id) m, max(s) OVER (PARTITION BY user_id) hi, min(s) OVER (PARTITION BY user_id) lo, s - lag(s) OVER (PARTITION BY user_id ORDER BY bucket_start) d,
        count(*) OVER (PARTITION BY user_id, s) rep, stddev_pop(s) OVER (PARTITION BY user_id) sd,
        lag(s, 1) OVER (PARTITION BY user_id ORDER BY bucket_start) p1, lag(s, 2) OVER (PARTITION BY user_id ORDER BY bucket_start) p2, lead(s) OVER (PARTITION BY user_id ORDER BY bucket_start) q1 FROM f)"""


def _features_sql(*columns: tuple[str, str]) -> str:
    return f"{_SERIES} SELECT user_id, " + ", ".join(f'round({sql}, 4) AS "somma__{name}"' for sql, name in columns) + " FROM x GROUP BY user_id"


register(
    "feat_basic", _features("sum_values", "absolute_maximum", "minimum", "maximum", "abs_energy", "mean", "median", "length", "root_mean_square"),
    _features_sql(("sum(v)", "sum_values"), ("max(abs(v))", "absolute_maximum"), ("min(v)", "minimum"), ("max(v)", "maximum"), ("sum(v * v)", "abs_energy"), ("avg(v)", "mean"), ("median(v)", "median"), ("CAST(count(*) AS DOUBLE)", "length"), ("sqrt(avg(v * v))", "root_mean_square")),
)
register(
    "feat_counts", _features("count_above", "count_below", "count_above_mean", "count_below_mean", "range_count", "value_count"),
    _features_sql(
        ("avg(CAST(v >= 0 AS DOUBLE))", "count_above__t_0"), ("avg(CAST(v <= 0 AS DOUBLE))", "count_below__t_0"), ("CAST(count(*) FILTER (v > m) AS DOUBLE)", "count_above_mean"), ("CAST(count(*) FILTER (v < m) AS DOUBLE)", "count_below_mean"),
        ("CAST(count(*) FILTER (v >= -1 AND v < 1) AS DOUBLE)", "range_count__max_1__min_-1"), ("CAST(count(*) FILTER (v >= -1e12 AND v < 0) AS DOUBLE)", "range_count__max_0__min_-1000000000000dot0"), ("CAST(count(*) FILTER (v >= 0 AND v < 1e12) AS DOUBLE)", "range_count__max_1000000000000dot0__min_0"),
        *[(f"CAST(count(*) FILTER (v = {k}) AS DOUBLE)", f"value_count__value_{k}") for k in (0, 1, -1)],
    ),
)
register(
    "feat_redundancy", _features("ratio_value_number_to_time_series_length", "has_duplicate", "has_duplicate_max", "sum_of_reoccurring_values", "percentage_of_reoccurring_datapoints_to_all_datapoints"),
    _features_sql(("count(DISTINCT v) / count(*)", "ratio_value_number_to_time_series_length"), ("CAST(count(DISTINCT v) < count(*) AS DOUBLE)", "has_duplicate"), ("CAST(count(*) FILTER (v = hi) >= 2 AS DOUBLE)", "has_duplicate_max"), ("coalesce(sum(DISTINCT v) FILTER (rep > 1), 0)", "sum_of_reoccurring_values"), ("count(*) FILTER (rep > 1) / count(*)", "percentage_of_reoccurring_datapoints_to_all_datapoints")),
)
register(
    "feat_dispersion", _features("standard_deviation", "variance", "variation_coefficient", "variance_larger_than_standard_deviation", "large_standard_deviation", "symmetry_looking"),
    _features_sql(
        ("stddev_pop(v)", "standard_deviation"), ("var_pop(v)", "variance"), ("stddev_pop(v) / nullif(avg(v), 0)", "variation_coefficient"), ("CAST(var_pop(v) > stddev_pop(v) AS DOUBLE)", "variance_larger_than_standard_deviation"),
        *[(f"CAST(stddev_pop(v) > {0.05 * k:.2f}::DOUBLE * (max(v) - min(v)) AS DOUBLE)", f"large_standard_deviation__r_{round(0.05 * k, 2)}".replace(".", "dot")) for k in range(1, 20)],
        *[(f"CAST(abs(avg(v) - median(v)) < {0.05 * k:.2f}::DOUBLE * (max(v) - min(v)) AS DOUBLE)", f"symmetry_looking__r_{round(0.05 * k, 2)}".replace(".", "dot")) for k in range(20)],
    ),
)
register(
    "feat_changes", _features("mean_abs_change", "mean_change", "absolute_sum_of_changes", "mean_second_derivative_central"),
    _features_sql(("avg(abs(d))", "mean_abs_change"), ("(max(v) FILTER (i = n) - max(v) FILTER (i = 1)) / nullif(max(n) - 1, 0)", "mean_change"), ("coalesce(sum(abs(d)), 0)", "absolute_sum_of_changes"), ("CASE WHEN max(n) > 2 THEN (max(v) FILTER (i = n) - max(v) FILTER (i = n - 1) - max(v) FILTER (i = 2) + max(v) FILTER (i = 1)) / (2 * (max(n) - 2)) END", "mean_second_derivative_central")),
)
register(
    "feat_location", _features("first_location_of_maximum", "last_location_of_maximum", "first_location_of_minimum", "last_location_of_minimum"),
    _features_sql(("(min(i) FILTER (v = hi) - 1) / max(n)", "first_location_of_maximum"), ("max(i) FILTER (v = hi) / max(n)", "last_location_of_maximum"), ("(min(i) FILTER (v = lo) - 1) / max(n)", "first_location_of_minimum"), ("max(i) FILTER (v = lo) / max(n)", "last_location_of_minimum")),
)
register(
    "feat_strikes", _features("longest_strike_above_mean", "longest_strike_below_mean"),
    f"""{_SERIES}, r AS (SELECT user_id, v > m up, v < m down, i - row_number() OVER (PARTITION BY user_id, v > m ORDER BY i) gu, i - row_number() OVER (PARTITION BY user_id, v < m ORDER BY i) gd FROM x),
        u AS (SELECT user_id, max(k) k FROM (SELECT user_id, gu, count(*) k FROM r WHERE up GROUP BY ALL) GROUP BY 1), d AS (SELECT user_id, max(k) k FROM (SELECT user_id, gd, count(*) k FROM r WHERE down GROUP BY ALL) GROUP BY 1)
        SELECT a.user_id, CAST(coalesce(u.k, 0) AS DOUBLE) AS "somma__longest_strike_above_mean", CAST(coalesce(d.k, 0) AS DOUBLE) AS "somma__longest_strike_below_mean" FROM (SELECT DISTINCT user_id FROM x) a LEFT JOIN u USING (user_id) LEFT JOIN d USING (user_id)""",
)
register("feat_quantile", _features("quantile"), _features_sql(*[(f"quantile_cont(v, {q})", f"quantile__q_{q}".replace(".", "dot")) for q in (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)]))
register("feat_skew_kurt", _features("skewness", "kurtosis"), _features_sql(("CASE WHEN max(n) > 2 AND max(sd) > 0 THEN avg(power((v - m) / nullif(sd, 0), 3)) * sqrt(max(n) * (max(n) - 1)) / (max(n) - 2) END", "skewness"), ("CASE WHEN max(n) > 3 AND max(sd) > 0 THEN (max(n) - 1) / ((max(n) - 2) * (max(n) - 3)) * ((max(n) + 1) * (avg(power((v - m) / nullif(sd, 0), 4)) - 3) + 6) END", "kurtosis")))


def _daily(places: int, *calculators: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        series = _filled(spark, d, "day").select("user_id", "bucket_start", "somma")
        return _rounded(FeatureGenerating("user_id", "bucket_start", feature_calculators=list(calculators), drop_nulls=False)(series), places)

    return query


for _name, (_calculators, _sql) in SERIES.items():
    register(_name, _daily(PLACES.get(_name, 4), *_calculators), _sql)
register("feat_all", lambda s, d: FeatureGenerating("user_id", "bucket_start")(_filled(s, d).drop("bucket_end")))
register("feat_catalog", lambda s, d: catalog(s))

# Relevance, splits and models ---------------------------------------------------------------------------------------


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Features of every user with the user's total as target."""
    f = _features("mean", "standard_deviation", "mean_abs_change", "longest_strike_above_mean", "has_duplicate_max", "count_above__t_0".split("__")[0])(spark, d).na.fill(0)
    y = _events(spark, d).groupBy("user_id").agg(F.sum("value").alias("totale"), F.count_if(F.col("event_type") == "purchase").alias("acquisti"))
    return f.join(y, "user_id")


register("relevance_real", lambda s, d: FeaturePruning("user_id", "totale").relevance(_labelled(s, d).drop("acquisti")))
register("relevance_classes", lambda s, d: FeaturePruning("user_id", "classe")(_labelled(s, d).withColumn("classe", (F.col("acquisti") > 6).cast("int")).drop("acquisti", "totale"))[1])
register("value_buckets", lambda s, d: value_buckets(table(s, d, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", 1000).select("o_orderkey", "bucket"), "SELECT o_orderkey, CAST(floor(o_totalprice / 1000) AS BIGINT) AS bucket FROM orders")
register("strat_hist", lambda s, d: stratified_histogram(table(s, d, "orders", "o_totalprice"), "o_totalprice", 10_000, above=0, below=30), "SELECT CAST(floor(o_totalprice / 10000) AS BIGINT) AS bucket, count(*) AS count FROM orders GROUP BY 1 HAVING bucket > 0 AND bucket < 30")
register("strat_split", lambda s, d: stratified_histogram(stratified_split(table(s, d, "orders", "o_orderkey", "o_totalprice"), "o_totalprice", 0.3, 10_000)[1], "o_totalprice", 10_000))
register("random_split", lambda s, d: random_split(table(s, d, "orders", "o_orderkey"), 0.3, 7)[1])
_CODES = "WITH c AS (SELECT o_orderstatus s, count(*) n FROM orders GROUP BY 1), k AS (SELECT s, row_number() OVER (ORDER BY n {}, s) - 1 AS k FROM c)"
register("label_encode", lambda s, d: label_encode(table(s, d, "orders", "o_orderkey", "o_orderstatus"), ["o_orderstatus"])[0], f"{_CODES.format('ASC')} SELECT o_orderkey, CAST(k AS DOUBLE) AS o_orderstatus FROM orders JOIN k ON s = o_orderstatus")
register("one_hot_encode", lambda s, d: one_hot_encode(table(s, d, "orders", "o_orderkey", "o_orderstatus"), ["o_orderstatus"])[0].select("o_orderkey", F.col("o_orderstatus").cast("string").alias("vettore")),
    f"{_CODES.format('DESC')}, z AS (SELECT max(k) z FROM k) SELECT o_orderkey, CASE WHEN k = z THEN '(' || z || ',[],[])' ELSE '(' || z || ',[' || k || '],[1.0])' END AS vettore FROM orders JOIN k ON s = o_orderstatus, z")
register("except_distinct", lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("chiave")).subtract(table(s, d, "orders").select(F.col("o_custkey").alias("chiave"))), "SELECT c_custkey AS chiave FROM customer EXCEPT SELECT o_custkey FROM orders")
register("sample_rows", lambda s, d: sample_rows(table(s, d, "orders", "o_orderkey"), 50))
register("sample_series", lambda s, d: sample_series(_events(s, d), "user_id", 10))


def _predicted(kind: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = _labelled(spark, d).withColumn("classe", (F.col("acquisti") > 6).cast("double"))
        features = [c for c in rows.columns if c.startswith("somma__")]
        helper = TrainingHelper(kind, features, "totale" if kind == "regression" else "classe").fit(rows, params={"maxIter": 5, "maxDepth": 3, "seed": 1})
        return helper.predict(rows).select("user_id", F.round("prediction", 4).alias("prediction"))

    return query


register("gbt_fit_predict", _predicted("regression"))
register("gbt_classify", _predicted("binary_classification"))
register(
    "stream_buckets_batch",
    lambda s, d: _rounded(streaming_buckets(_events(s, d), ["user_id"], "ts", 1, "week", [F.sum("value").alias("somma")])),
    f"{_W} SELECT {_KEYS}, round(sum(value), 4) AS somma FROM w GROUP BY user_id, bucket_start",
)
