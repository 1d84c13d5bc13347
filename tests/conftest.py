import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from grainmill.session import local_session

    s = local_session(4, "tests", **{"spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    return s
