from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from presswerk.session import session

    shared = tmp_path_factory.mktemp("shared")
    s = session(
        "tests",
        **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{shared}", "spark.driver.memory": "3g", "spark.sql.warehouse.dir": str(shared / "warehouse")},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
