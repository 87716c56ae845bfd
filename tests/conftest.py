import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from rillwork.session import local_session

    s = local_session(cores=4, shuffle_partitions=2, app="tests", spark__sql__codegen__wholeStage="false")
    yield s
    s.stop()
