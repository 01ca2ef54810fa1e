import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from tidemark.plans import story  # noqa: E402
from tidemark.session import get_session  # noqa: E402

START = "2024-01-01 00:00:00"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def customers(spark, tmp_path_factory):
    """The seed story's customers. Read only: tests that write make their own table."""
    return story.seed_customers(spark, str(tmp_path_factory.mktemp("story") / "customers"), START)


@pytest.fixture(scope="session")
def products(spark, tmp_path_factory):
    return story.seed_products(spark, str(tmp_path_factory.mktemp("story") / "products"), START)
