import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    where = tempfile.mkdtemp(prefix="spark-tests-")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.local.dir", where)
        .config("spark.sql.warehouse.dir", f"{where}/warehouse")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from junctura.deploy import ship

    ship(s)
    yield s
    s.stop()
