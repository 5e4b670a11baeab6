import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bucketed(spark):
    """Rows already in daily buckets (shape F4 of the fixtures)."""
    # The rows that the expected results of the tests belong to.
    a, b = 348272371, 234984832
    rows = [
        (a, "2023-01-01", 55, "shopping", True), (a, "2023-01-01", 61, "salute", False), (a, "2023-01-01", 82, "trasporti", False), (a, "2023-01-01", 15, "trasporti", True),
        (a, "2023-01-06", 202, "shopping", False), (a, "2023-01-06", 430, "shopping", True), (a, "2023-01-06", 722, "shopping", False),
        (b, "2023-01-01", 153, "salute", True), (b, "2023-01-01", 362, "salute", True), (b, "2023-01-01", 783, "salute", False), (b, "2023-01-02", 22, "trasporti", True),
    ]
    df = spark.createDataFrame(rows, "ID_BIC_CLIENTE bigint, g string, IMPORTO bigint, CA_CATEGORY_LIV0 string, IS_CARTA boolean")
    return df.selectExpr("ID_BIC_CLIENTE", "IMPORTO", "CA_CATEGORY_LIV0", "IS_CARTA", "cast(g as timestamp_ntz) bucket_start", "cast(g as timestamp_ntz) + interval 86399 seconds bucket_end")
