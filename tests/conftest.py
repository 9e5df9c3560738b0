import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "3").config("spark.default.parallelism", "3").config("spark.sql.adaptive.enabled", "false")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("ckpt"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
