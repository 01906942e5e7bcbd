import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))])


@pytest.fixture(scope="session")
def spark():
    from quirefold.session import local_session

    s = local_session("4", 3, "tests", **{"spark.sql.autoBroadcastJoinThreshold": "256k"})
    yield s
    s.stop()
