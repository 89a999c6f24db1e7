import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from twinfinder.schema import FILE_RECORD, normalise  # noqa: E402
from twinfinder.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("twinfinder-tests")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.leafNodeDefaultParallelism", "2")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Records from dicts; seq counts up unless given."""
    def build(*rows, repo="r"):
        full = [
            tuple({"repo": repo, "seq": i, **row}.get(f.name) for f in FILE_RECORD) for i, row in enumerate(rows, 1)
        ]
        return normalise(spark.createDataFrame(full, FILE_RECORD))
    return build


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
