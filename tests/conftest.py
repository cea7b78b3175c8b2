from __future__ import annotations

import os
import sys

import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from packetloom.session import build_session

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]",
        "tests",
        **{
            "spark.driver.memory": "4g",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def labelled_rows() -> pd.DataFrame:
    """Fourteen calm and twelve busy links on a fixed grid; each feature tells the classes apart."""
    calm = [(1 + i % 5 / 10, 2 + i % 3 / 5, i % 7 / 8, -1 - i % 2 / 4) for i in range(14)]
    busy = [(6 + i % 4 / 10, 8 + i % 5 / 5, 4 + i % 3 / 8, 3 + i % 6 / 9) for i in range(12)]
    return pd.DataFrame(calm + busy, columns=["rate", "size", "spread", "burst"]).assign(label=[0] * 14 + [1] * 12)


@pytest.fixture(scope="session")
def labelled(spark, labelled_rows):
    return spark.createDataFrame(labelled_rows)
