import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from gleaner.session import build_session

    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
