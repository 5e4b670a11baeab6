import datetime as dt
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lunario.functions.predicates import OrGroup
from lunario.functions.series.catalog import catalog, names, tier
from lunario.operators.bucketing import tag_windows
from lunario.operators.features import drop_null_columns, unpivot_series
from lunario.operators.sampling import random_split, sample_rows, sample_series, stratified_histogram, stratified_split, value_buckets
from lunario.plans import model as M
from lunario.plans.pipeline import build, filter_from
from lunario.sources.io import read_csv, read_parquet, write_csv, write_parquet
from lunario.streaming.windows import streaming_buckets
from lunario.types import is_categorical, is_numeric, is_time, is_window, need_rows


def test_kinds_of_columns(spark, bucketed):
    assert is_numeric(bucketed, "IMPORTO") and is_categorical(bucketed, "IS_CARTA") and is_time(bucketed, "bucket_start")
    assert is_window(tag_windows(bucketed), "bucket") and not is_window(bucketed, "bucket_start")
    d = spark.sql("select cast(1 as decimal(5,2)) d")
    assert is_numeric(d, "d") and not is_numeric(d, "d", strict=True)
    with pytest.raises(ValueError, match="DataFrame should not be empty"):
        need_rows(d.where("false"), "DataFrame should not be empty")


def test_pipeline_from_config(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, start + dt.timedelta(days=k), float(k), "ab"[k % 2]) for k in (0, 1, 4)], "id int, t timestamp_ntz, v double, c string")
    config = {
        "ids": ["id"], "time": "t", "bucket": {"size": 1, "granularity": "day"}, "features": ["sum_values", "length"],
        "aggregations": [{"col": "v", "fn": "sum", "name": "s", "filters": [{"or": [{"col": "c", "op": "=", "value": "a"}, {"col": "v", "op": ">", "value": 0}]}]}],
    }
    assert build(config)(df).collect() == [(1, 5.0, 5.0)]
    assert isinstance(filter_from({"or": [{"col": "c", "op": "=", "value": "a"}], "name": "x"}), OrGroup)


def test_reshape(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1, 2.5)], "id int, t timestamp_ntz, a int, b double")
    assert sorted(unpivot_series(df, "id", "t").select("kind", "value").collect()) == [("a", 1.0), ("b", 2.5)]
    wide = spark.range(3).select("id", *[(F.when(F.col("id") > (0 if k % 7 == 0 else -1), 1)).alias(f"c.{k}") for k in range(130)])
    assert len(drop_null_columns(wide).columns) == 131 - 19


def test_samples_and_splits(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), ((F.col("id") % 50) * 10.0 - 100).alias("v"))
    assert sample_rows(df, 30).count() == 30 and sample_rows(df, 5000).count() == 1000
    assert sample_series(df, "k", 2).select("k").distinct().count() == 2
    train, test = random_split(df, 0.3, 1)
    assert train.count() + test.count() == 1000
    twice = df.union(df).cache()
    train, test = stratified_split(twice, "v", 0.4, 100)
    assert train.count() + test.count() == 2000 and 600 < test.count() < 1000
    assert {r.bucket: r["count"] for r in stratified_histogram(df, "v", 100, above=-1, below=2).collect()} == {0: 200, 1: 200}
    assert value_buckets(spark.sql("select double('nan') v"), "v").first().bucket is None
    with pytest.raises(ValueError):
        random_split(df, 1)


def test_catalog(spark):
    assert all(tier(n) for n in names()) and catalog(spark).count() == 7
    assert {r.feature for r in catalog(spark, feature="count_above").collect()} == {"count_above", "count_above_mean"}
    assert catalog(spark, tag="trend").count() == 7


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "è|x"), (2, None)], "a int, b string")
    write_parquet(df, f"{tmp_path}/p")
    write_csv(df, f"{tmp_path}/c")
    assert sorted(read_parquet(spark, f"{tmp_path}/p", "a").collect()) == [(1,), (2,)]
    assert sorted(read_csv(spark, f"{tmp_path}/c", "a int, b string").collect(), key=str) == sorted(df.collect(), key=str)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(k, k % 10 / 10, "xyz"[k % 3], "uv"[k % 2], float(k % 10 > 4), 3.0 * (k % 10)) for k in range(200)]
    return spark.createDataFrame(rows, "id int, f double, o string, u string, y double, z double").cache()


def test_helper(spark, labelled, tmp_path):
    h = M.TrainingHelper("binary_classification", ["f", "o", "u"], "y", ["o"], ["u"]).fit(labelled, params={"maxIter": 3, "seed": 1})
    assert h.score(h.predict(labelled), "accuracy") == 1.0 and h.parameters()["maxIter"] == 3
    weights = {r.feature: r.importance for r in h.feature_importance(spark, "weight").collect()}
    assert weights["f"] > 0 and set(weights) == {"f", "o", "u_u"}
    assert {k: h.feature_importance(spark, k).count() for k in M.IMPORTANCES} == dict.fromkeys(M.IMPORTANCES, 3)
    h.save(spark, f"{tmp_path}/h")
    again = M.TrainingHelper.load(spark, f"{tmp_path}/h")
    assert again.predict(labelled).select("prediction").collect() == h.predict(labelled).select("prediction").collect()
    with pytest.raises(FileNotFoundError):
        M.TrainingHelper.load(spark, f"{tmp_path}/nothing")
    with pytest.raises(ValueError):
        h.fit(labelled, params={"maxIter": [1, 2]})
    with pytest.raises(ValueError, match="is not a feature"):
        M.TrainingHelper("regression", ["f"], "z", ["o"])


def test_tuning(labelled):
    h = M.TrainingHelper("regression", ["f"], "z")
    best, value, scores = h.tune(labelled, labelled, {"maxIter": [1, 5], "maxDepth": 2}, "r2")
    assert len(scores) == 2 and value == max(s for _, s in scores) and best["maxIter"] in (1, 5) and M.better("rmse") == "min"
    assert len(h.tune_cv(labelled, {"maxIter": [1, 2]}, "rmse", folds=2)) == 2
    with pytest.raises(ValueError, match="Metric not supported"):
        M.evaluator("nothing")


def test_encoders(labelled):
    out, _, encoding = M.label_encode(labelled, ["o"], order="descending")
    first = out.where("id < 3").orderBy("id").collect()
    assert [encoding["o"][int(r.o)] for r in first] == ["x", "y", "z"]
    hot, _, names_ = M.one_hot_encode(labelled, ["u"])
    vec, slots = M.vector_assemble(hot, ["f", "u"], encoding=names_)
    assert slots == ["f", "u_u"] and vec.first().features.size == 2
    assert M.features_columns(labelled, ["id", "y"]) == ["f", "o", "u", "z"]


def test_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, start + dt.timedelta(days=k), 1.0) for k in range(20)], "id int, t timestamp_ntz, v double")
    rows.write.parquet(f"{tmp_path}/in")
    make = lambda df: streaming_buckets(df, ["id"], "t", 1, "week", [F.sum("v").alias("s")])
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = make(stream).writeStream.outputMode("complete").format("memory").queryName("weekly").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("weekly").collect()) == sorted(make(rows).collect())
    assert min(r.bucket_start for r in spark.table("weekly").collect()) == start
    with pytest.raises(ValueError):
        streaming_buckets(rows, ["id"], "t", 1, "month", [])


def test_the_core_stands_without_the_corpus_operators():
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['lunario.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and not any(q.startswith(('p2_', 'p7_')) for q in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, check=False).returncode == 0
    used = [p for p in (root / "lunario").rglob("*.py") if "llm" not in p.parts and "lunario.llm" in p.read_text()]
    assert used == []
