import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    s = builder.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


ROWS = (
    "tenant_id string, project_id string, dataset_version_id string, row_number long, "
    "fields array<string>"
)


@pytest.fixture(scope="session")
def make_rows(spark):
    def make(data, version="v", tenant="t"):
        return spark.createDataFrame(
            [(tenant, "p", version, i + 1, list(r)) for i, r in enumerate(data)], ROWS
        )
    return make


@pytest.fixture(scope="session")
def make_columns(spark):
    from fairledger.operators.cells import columns_from_table

    def make(names, version="v", tenant="t"):
        return columns_from_table(spark.range(0), tenant, "p", version, names)
    return make
