import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kinetable.plans.session import session
    s = session("local[8]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
                                        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def cloud(spark):
    """(frames, vertices, 3) array to a point table."""
    def make(arr, seq="s", first=0):
        rows = [(seq, f + first, v, *map(float, arr[f, v])) for f in range(arr.shape[0]) for v in range(arr.shape[1])]
        return spark.createDataFrame(rows, "seq_id string, frame_id long, vertex_id long, x double, y double, z double")
    return make
