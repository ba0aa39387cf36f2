import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate a column expression over a list of strings."""
    from pyspark.sql import functions as F

    def run(build, inputs):
        rows = [(i, v) for i, v in enumerate(inputs)]
        df = spark.createDataFrame(rows, "i int, v string")
        return [r[1] for r in sorted(df.select("i", build(F.col("v")).alias("o")).collect())]

    return run
