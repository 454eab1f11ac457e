import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lumenframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture()
def folder(tmp_path_factory):
    return str(tmp_path_factory.mktemp("lf"))
