import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows("a int, b string", (1, "x"), …) as a DataFrame."""

    def make(schema, *values):
        return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)

    return make


@pytest.fixture
def evaluate(rows):
    """Apply a Column function to single texts and return the results in order."""

    def run(function, *texts, schema="string"):
        from pyspark.sql import functions as F

        table = rows(f"i int, x {schema}", *enumerate(texts))
        out = table.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()
        return [r["y"] for r in out]

    return run


@pytest.fixture
def on_nodes(rows):
    """Apply a function of a page's nodes to HTML texts and return the results in order."""

    def run(fact, *html):
        from pyspark.sql import functions as F

        from sitescan.operators.pages import with_nodes

        table = with_nodes(rows("i int, html string", *enumerate(html)))
        out = table.select("i", fact(F.col("nodes")).alias("y")).orderBy("i").collect()
        return [r["y"] for r in out]

    return run
