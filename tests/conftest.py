import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vecloom.runtime import session, ship

    s = session("tests", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"})
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("scratch")))
    ship(s)
    yield s
    s.stop()
