from __future__ import annotations

import pytest

from barloom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    where = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g",
        spark__sql__warehouse__dir=str(where / "warehouse"), spark__checkpoint__dir=str(where / "checkpoints"),
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
