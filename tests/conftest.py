import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from wattframe.session import build_session

    session = build_session(
        "tests",
        master="local[8]",
        conf={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture
def prices(spark):
    """Rows ``(timestamp text, price)`` or ``(timestamp text, price, point)`` to a market table."""
    from pyspark.sql import functions as F

    def make(rows):
        full = [(i, r[0], r[2] if len(r) > 2 else "HB", r[1]) for i, r in enumerate(rows)]
        return spark.createDataFrame(
            full, "row_id bigint, timestamp string, settlement_point string, price double"
        ).withColumn("timestamp", F.to_timestamp("timestamp"))

    return make
