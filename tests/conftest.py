import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[4]").appName("pagelens-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagelens-test-ckpt-"))
    yield s


def pages_df(spark, htmls, urls=None):
    urls = urls or [f"https://example.org/p/{i}" for i in range(len(htmls))]
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, htmls))],
                                 "page_id long, url string, html string")
