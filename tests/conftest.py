import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
         .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def short_segments(spark):
    """Segments of 16 frames, so that small fixtures cross many borders."""
    spark.conf.set("spark.framescope.segmentFrames", "16")
    yield spark
    spark.conf.set("spark.framescope.segmentFrames", "4096")


@pytest.fixture(scope="session")
def sf():
    return SF
