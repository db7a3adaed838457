import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from panelcast.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[4]").appName("panelcast-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


def panel_df(spark, cases: dict, k: int):
    """One panel frame holding every case as its own series: (series_id, t, var0..var{k-1})."""
    rows = []
    for sid, ys in cases.items():
        for t, y in enumerate(ys):
            y = y if isinstance(y, (list, tuple)) else [y]
            rows.append((sid, t, *[float(v) for v in y]))
    cols = ", ".join(f"var{i} double" for i in range(k))
    return spark.createDataFrame(rows, f"series_id string, t bigint, {cols}")
