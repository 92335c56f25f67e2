import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from sealrank.functions.sealing import load_key, save_key  # noqa: E402
from sealrank.session import build_session, new_path, ship_package  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session()
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def key(spark):
    return load_key(spark, save_key(spark, b"0123456789abcdef" * 2, new_path(spark, "key")))


@pytest.fixture
def path(spark):
    return lambda name="t": new_path(spark, name)
