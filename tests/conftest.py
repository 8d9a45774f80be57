import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{base}/shared")
        .config("spark.sql.warehouse.dir", f"{base}/warehouse")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def g0(spark):
    """A small graph with a cycle, a parallel edge, a self-loop, an isolated vertex and a missing property."""
    from wayfare.operators.graph import PropertyGraph

    v = spark.createDataFrame([(1, "US"), (2, "IN"), (3, "US"), (4, "DE"), (5, None), (6, "IN")], "id bigint, c string")
    e = spark.createDataFrame(
        [(1, 2, 10, "a"), (2, 3, 11, "a"), (3, 1, 12, "b"), (1, 3, 13, "b"), (1, 3, 14, "a"), (3, 4, 15, "a"), (4, 4, 16, "a"), (4, 5, 17, "b")],
        "src bigint, dst bigint, edge_id bigint, r string",
    )
    return PropertyGraph(v.cache(), e.cache())
