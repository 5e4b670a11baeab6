import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lunario.functions.predicates import Filter
from lunario.functions.series.arrays import query_similarity_count
from lunario.functions.stats import fisher, smirnov
from lunario.operators.aggregating import Aggregating, Aggregation, Pivot
from lunario.operators.bucketing import TimeBucketing
from lunario.operators.filling import Filling
from lunario.operators.sampling import stratified_split
from lunario.operators.steps import Step
from lunario.plans.model import estimator, one_hot_encode
from lunario.session import shared_dir


def test_empty_tables_are_an_error(bucketed):
    none = bucketed.where("false")
    for step in (Aggregating(["ID_BIC_CLIENTE"], ["bucket_start", "bucket_end"], [Aggregation("IMPORTO", "sum")]), Filling(["ID_BIC_CLIENTE"], TimeBucketing("bucket_start", 1, "day"))):
        with pytest.raises(ValueError, match="Empty DataFrame"):
            step(none)


@pytest.mark.parametrize("f", [Filter("IS_CARTA", "in", [1, 2]), Filter("CA_CATEGORY_LIV0", "notin", [1]), Filter("IMPORTO", "in", ["a"])])
def test_lists_must_go_with_the_column(bucketed, f):
    with pytest.raises(ValueError, match="Mismatch types between"):
        f.check(bucketed)


def test_a_pivot_of_too_many_values_is_refused(bucketed):
    step = Aggregating(["ID_BIC_CLIENTE"], ["bucket_start", "bucket_end"], [Aggregation("IMPORTO", "sum", pivot=Pivot("CA_CATEGORY_LIV0"))], most_pivot_values=2)
    with pytest.raises(ValueError, match="at most 2"):
        step(bucketed)


def test_a_step_of_ones_own(bucketed):
    class Doubled(Step):
        def preprocess(self, df):
            return df.where("IS_CARTA")

        def process(self, df):
            return df.withColumn("x", F.col("IMPORTO") * 2)

    assert Doubled()(bucketed).where("x <> IMPORTO * 2 or not IS_CARTA").count() == 0


def test_stratified_split_has_its_share_of_every_bucket(spark):
    rows = [(k, float(k % 3 * 100 + k % 7)) for k in range(3000)] + [(5000 + k, None) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, v double").withColumn("_h", F.lit("clash"))
    train, test = stratified_split(df, "v", 0.25)
    sides = [{r["k"] for r in side.repartition(3).collect()} for side in (train, test)]
    assert not sides[0] & sides[1] and len(sides[0]) + len(sides[1]) == len(rows) and train.columns == df.columns
    by = lambda side: [sum(1 for k, v in rows if k in side and (None if v is None else v // 100) == b) for b in (0.0, 1.0, 2.0, None)]
    assert by(sides[1]) == [250, 250, 250, 100]


def test_distance_of_small_unequal_groups_is_exact():
    rng = random.Random(5)
    for n1, n2 in ((3, 5), (4, 6), (2, 7), (5, 5)):
        for _ in range(4):
            y = np.array([rng.random() for _ in range(n1 + n2)])
            group = np.array([1.0] * n1 + [0.0] * n2)

            def gap(own):
                g = np.array([k in own for k in range(n1 + n2)], float)
                o = np.argsort(y)
                return round(np.abs(np.cumsum(g[o]) / n1 - np.cumsum(1 - g[o]) / n2).max(), 9)

            seen = gap(set(range(n1)))
            every = [gap(set(c)) for c in itertools.combinations(range(n1 + n2), n1)]
            assert abs(smirnov(y, group, np.ones(n1 + n2)) - sum(g >= seen for g in every) / len(every)) < 1e-9


def test_table_test_of_large_counts():
    assert abs(fisher(3, 1, 1, 3) - 0.4857142857142857) < 1e-12 and abs(fisher(400_000, 100_000, 399_000, 101_000) - 0.0126) < 2e-4


def test_windows_like_a_query():
    x = np.array([0, 1, 0, 5, 10, 5, 3, 3, 3], float)
    assert query_similarity_count(x, [{"query": None, "threshold": 0.0}, {"query": [0, 1, 0], "threshold": 1e-6}, {"query": [1, 1], "threshold": 1}])[:2] == [0.0, 2.0]


def test_two_tables_share_an_encoding(spark):
    a, b = (spark.createDataFrame([(x,) for x in t], "c string") for t in ("xxyzz", "zzzx"))
    _, model, names = one_hot_encode(a, ["c"])
    out, _, again = one_hot_encode(b, ["c"], model=model)
    assert names == again and out.count() == 4
    assert estimator("regression", objective="absolute").getLossType() == "absolute"


def test_no_local_folder_where_executors_are_elsewhere():
    class Context:
        master = "yarn"
        getConf = lambda self: {}
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
