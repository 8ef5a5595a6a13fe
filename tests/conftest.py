import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


def rows_of(frame):
    """Rows as strings, columns by name, in any order; floats by their shortest form."""
    import math

    frame = frame[sorted(frame.columns)]
    show = lambda x: "~" if x is None or (isinstance(x, float) and math.isnan(x)) else repr(float(x)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in frame.itertuples(index=False))
