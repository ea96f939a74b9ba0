from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexiloom.session import build

    at = tmp_path_factory.mktemp("shared")
    s = build(master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(at), "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
